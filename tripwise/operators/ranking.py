"""Recommendations: place scores, top-k per request, sources.

Requests: rid, user_id, subtype, lat, lon, query_keywords, interest_keywords.
Places: place_id, pos (catalog order), category, lat, lon, keywords, rating,
review_count, popularity.  Affinities: (user_id, place_id, aff), (user_id,
keyword, aff) of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import clamp, haversine_km, jaccard, minmax_by_group, normalize_tokens
from tripwise.functions.text import lookup
from tripwise.operators.boxtree import best_k, build_tree, drop_copies, _joined_by_size, sphere_bounds
from tripwise.operators.catalog import pois_by_subtype
from tripwise.session import kept


def prominence(by_subtype: DataFrame) -> DataFrame:
    """Rating and review signal; the review part is normalised over the whole
    candidate set of the subtype, so it is the same for every user."""
    rated = by_subtype.withColumn("_r", F.log1p(F.greatest(F.lit(0), F.col("review_count")).cast("double")))
    scaled = minmax_by_group(rated, ["subtype"], "_r", "_n")
    return scaled.withColumn("prominence", 0.55 * clamp("rating", 0.0, 5.0) / 5.0 + 0.45 * F.col("_n")).drop("_r", "_n")


def popularity_score(places: DataFrame) -> DataFrame:
    """Rating, reviews and visits of a place, on their own scale."""
    w = P.POPULARITY_RANK
    total = w["rating"] + w["review"] + w["popularity"]
    return places.withColumn("popularity_score", (
        w["rating"] / total * clamp("rating", 0.0, 5.0) / 5.0
        + w["review"] / total * F.log1p(F.greatest(F.lit(0), F.col("review_count")).cast("double"))
        + w["popularity"] / total * F.log1p(F.greatest(F.lit(0.0), F.col("popularity").cast("double")))
    ))


def relevance(place_tokens: Column, query_tokens: Column, interest_tokens: Column) -> Column:
    return 0.75 * jaccard(place_tokens, query_tokens) + 0.25 * jaccard(place_tokens, interest_tokens)


def default_query(subtype: Column) -> Column:
    args = []
    for s, words in P.SUBTYPE_KEYWORDS.items():
        args += [F.lit(s), F.array(*map(F.lit, words))]
    return F.try_element_at(F.create_map(*args), subtype)


def proximity(distance_km: Column, scale_km: float = P.PROMINENCE_RANK["scale_km"], coord_scale: float = 1.0) -> Column:
    return F.exp(-distance_km * coord_scale / max(0.1, scale_km))


def personalization(place_aff: Column, keyword_aff: Column) -> Column:
    """Learned affinity in [-1, 1] mapped to [0, 1]; missing parts count as 0."""
    return clamp(0.5 * (0.6 * F.coalesce(place_aff, F.lit(0.0)) + 0.4 * F.coalesce(keyword_aff, F.lit(0.0)) + 1.0))


def personalization_score(pairs: DataFrame, place_aff: DataFrame, keyword_aff: DataFrame) -> DataFrame:
    """Personal score of given (user_id, place_id, keywords) pairs."""
    words = keyword_maps(keyword_aff)
    return (
        pairs.join(place_aff.select("user_id", "place_id", "aff"), ["user_id", "place_id"], "left").join(words, "user_id", "left")
        .withColumn("personalization", personalization(F.col("aff"), mean_keyword_affinity(F.col("keywords"), F.col("_words"))))
        .drop("aff", "_words")
    )


def keyword_maps(keyword_aff: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Key-word affinities per user as a map; bounded by the vocabulary."""
    return keyword_aff.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("keyword", "aff"))).alias("_words"))


def mean_keyword_affinity(keywords: Column, words: Column) -> Column:
    total = F.aggregate(keywords, F.lit(0.0), lambda acc, k: acc + F.coalesce(F.try_element_at(words, F.lower(k)), F.lit(0.0)))
    return F.when(words.isNull() | (F.size(keywords) == 0), F.lit(0.0)).otherwise(total / F.size(keywords))


def _personal_weight(w: float) -> float:
    return max(0.0, min(P.PERSONAL_CAP, w))


USER = ["source", "user_id"]


class _Personal:
    """Affinities per source and user; empty tables stand in for missing ones."""

    def __init__(self, requests: DataFrame, place_aff: DataFrame | None, keyword_aff: DataFrame | None, source: str):
        def table(df: DataFrame | None, key: str) -> DataFrame:
            if df is None:
                return requests.sparkSession.createDataFrame([], f"source string, user_id long, {key}, aff double")
            return df if "source" in df.columns else df.withColumn("source", F.lit(source))

        self.places = table(place_aff, "place_id long").select(*USER, "place_id", "aff")
        self.words = keyword_maps(table(keyword_aff, "keyword string").select(*USER, "keyword", "aff"), tuple(USER))
        self.rated = self.places.groupBy(*USER).agg(F.count(F.lit(1)).alias("_m"))

    def most(self, k: int) -> int:
        """Longest list any request can ask for."""
        return max(1, k) + (self.rated.agg(F.max("_m")).first()[0] or 0)


def _tagged(requests: DataFrame, source: str) -> DataFrame:
    return requests if "source" in requests.columns else requests.withColumn("source", F.lit(source))


def _classes(candidates: DataFrame) -> DataFrame:
    """Candidates tagged with a root per (subtype, key-word set): within a root the
    key-word part of the score is the same for all places of a request."""
    tokens = F.array_sort(normalize_tokens("keywords"))
    return candidates.withColumn("tokens", tokens).withColumn("root", F.concat_ws("|", "subtype", F.array_join("tokens", "/")))


def _asks(requests: DataFrame, candidates: DataFrame, personal: _Personal, k: int) -> DataFrame:
    """One row per request and root with relevance and key-word affinity.  A
    request asks for as many extra items as its user has rated places: however
    those move, k items without a rating are then among the answers."""
    roots = kept(candidates.groupBy("subtype", "root").agg(F.first("tokens").alias("tokens"), F.first("keywords").alias("keywords")))
    # the requests may look smaller than the roots, but are not
    roots = _joined_by_size(roots, roots.count(), 0)
    query = F.when(F.size("query_keywords") > 0, F.col("query_keywords")).otherwise(default_query(F.col("subtype")))
    return (
        requests.withColumns({"_q": normalize_tokens(query), "_i": normalize_tokens(F.col("interest_keywords"))})
        .join(roots, "subtype").join(personal.words, USER, "left").join(personal.rated, USER, "left")
        .select(
            "rid", *USER, "subtype", "root", "lat", "lon",
            (F.lit(max(1, k)) + F.coalesce("_m", F.lit(0))).alias("k"),
            relevance(F.col("tokens"), F.col("_q"), F.col("_i")).alias("relevance"),
            mean_keyword_affinity(F.col("keywords"), F.col("_words")).alias("kw_aff"),
        )
    )


def _own_pairs(asks: DataFrame, candidates: DataFrame, personal: _Personal, columns: list[str]) -> DataFrame:
    """The (request, place) pairs a user has an affinity for."""
    # read back, the candidates and the requests look smaller than they are
    mine = personal.places.join(candidates.select("root", *columns).hint("merge"), "place_id")
    return asks.hint("merge").join(mine, USER + ["root"])


def _final(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("rid", "source").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _with_own(base: DataFrame, own: DataFrame, columns: list[str]) -> DataFrame:
    """Answers without affinities, with the user's own rated places put in their place."""
    plain = base.join(own.select("rid", "source", "place_id"), ["rid", "source", "place_id"], "left_anti")
    return plain.select(*columns).unionByName(own.select(*columns))


RANKED = ["rid", "source", "user_id", "subtype", "place_id", "pos", "score"]


def rank_prominence(requests: DataFrame, places: DataFrame, k: int = 5, place_aff: DataFrame | None = None,
                    keyword_aff: DataFrame | None = None, weights: dict = P.PROMINENCE_RANK,
                    source: str = "google_maps") -> DataFrame:
    """Top-k by prominence, relevance, proximity and personal affinity."""
    total = weights["prominence"] + weights["relevance"] + weights["proximity"]
    wp, wr, wd = (weights[x] / total for x in ("prominence", "relevance", "proximity"))
    pw = _personal_weight(weights["personal"])
    requests = _tagged(requests, source)
    personal = _Personal(requests, place_aff, keyword_aff, source)
    candidates = kept(_classes(prominence(pois_by_subtype(places))))
    asks = _asks(requests, candidates, personal, k)
    most = personal.most(k)
    items = drop_copies(candidates.select(
        "root", "place_id", "pos", F.col("lat").alias("south"), F.col("lon").alias("west"), F.col("lat").alias("north"),
        F.col("lon").alias("east"), F.col("prominence").alias("s")), most)

    def score(s: Column, d: Column, place: Column | None = None) -> Column:
        base = wp * s + wr * F.col("relevance") + wd * proximity(d, weights["scale_km"])
        return (1.0 - pw) * base + pw * personalization(F.lit(0.0) if place is None else place, F.col("kw_aff"))

    # within a root only static score and place decide: one search per root and spot serves all its requests
    asks = kept(asks)
    spots = asks.groupBy("root", "lat", "lon").agg(F.max("k").alias("k")).withColumn("rid", F.struct("root", "lat", "lon"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("i_south"), F.col("i_west"))
    found = best_k(spots, build_tree(items, use_static=True), lambda s, dist: wp * s + wd * proximity(dist, weights["scale_km"]),
                   wp * F.col("i_s") + wd * proximity(d, weights["scale_km"]))
    row = F.struct("rank", F.col("i_place_id").alias("place_id"), F.col("i_pos").alias("pos"), F.col("i_s").alias("prominence"), d.alias("distance_km"))
    lists = kept(found.groupBy("root", "lat", "lon").agg(F.array_sort(F.collect_list(row)).alias("_found")))
    met = asks.join(lists.hint("merge"), ["root", "lat", "lon"]).withColumn("_x", F.explode(F.slice("_found", F.lit(1), F.col("k").cast("int"))))
    met = met.select(*asks.columns, "_x.place_id", "_x.pos", "_x.prominence", "_x.distance_km")
    base = met.withColumns({
        "score": score(F.col("prominence"), F.col("distance_km")), "proximity": proximity(F.col("distance_km"), weights["scale_km"]),
        "personalization": personalization(F.lit(0.0), F.col("kw_aff"))})
    own = _own_pairs(asks, candidates.withColumns({"p_lat": F.col("lat"), "p_lon": F.col("lon")}), personal,
                     ["place_id", "pos", "prominence", "p_lat", "p_lon"])
    d_own = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    own = own.withColumns({
        "score": score(F.col("prominence"), d_own, F.col("aff")), "proximity": proximity(d_own, weights["scale_km"]),
        "personalization": personalization(F.col("aff"), F.col("kw_aff")), "distance_km": d_own,
    })
    columns = [*RANKED, "prominence", "relevance", "proximity", "personalization", "distance_km"]
    return _final(_with_own(base, own, columns), max(1, k))


def top_per_root(items: DataFrame, value: str, most: int) -> DataFrame:
    """The first ``most`` items of every root by value; the limit is applied before
    the shuffle too."""
    best = Window.partitionBy("root").orderBy(F.desc(value), "pos")
    return items.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= most)


def rank_popularity(requests: DataFrame, places: DataFrame, k: int = 5, place_aff: DataFrame | None = None,
                    keyword_aff: DataFrame | None = None, personal_weight: float = P.POPULARITY_RANK["personal"],
                    source: str = "opentable") -> DataFrame:
    """Top-k by normalised popularity and personal affinity.  Popularity does not
    depend on the user, so each request reads only the head of its root's list."""
    pw = _personal_weight(personal_weight)
    requests = _tagged(requests, source)
    personal = _Personal(requests, place_aff, keyword_aff, source)
    scored = minmax_by_group(popularity_score(pois_by_subtype(places)), ["subtype"], "popularity_score", "norm")
    candidates = kept(_classes(scored))
    asks = _asks(requests, candidates, personal, k)
    most = personal.most(k)
    head = top_per_root(candidates.select("root", "place_id", "pos", "norm", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "norm", most)

    def score(aff: Column) -> Column:
        return (1.0 - pw) * F.col("norm") + pw * personalization(aff, F.col("kw_aff"))

    here = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    # one lookup per wanted rank: a request never meets more than its k places
    looked = asks.withColumn("_rn", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    base = looked.join(head, ["root", "_rn"]).withColumns({
        "score": score(F.lit(0.0)), "personalization": personalization(F.lit(0.0), F.col("kw_aff")), "distance_km": here})
    own = _own_pairs(asks, candidates.withColumns({"p_lat": F.col("lat"), "p_lon": F.col("lon")}), personal, ["place_id", "pos", "norm", "p_lat", "p_lon"]).withColumns({
        "score": score(F.col("aff")), "personalization": personalization(F.col("aff"), F.col("kw_aff")), "distance_km": here})
    columns = [*RANKED, "norm", "personalization", "distance_km"]
    return _final(_with_own(base, own, columns), max(1, k))


def route_sources(requests: DataFrame, routes=P.SOURCE_ROUTES) -> DataFrame:
    """Requests with the sources that answer their subtype, in answer order."""
    by_subtype: dict[str, list] = {}
    for subtype, source, position in routes:
        by_subtype.setdefault(subtype, []).append((source, position))
    args = []
    for subtype, found in by_subtype.items():
        args += [F.lit(subtype), F.array(*[F.struct(F.lit(s).alias("source"), F.lit(p).alias("source_pos")) for s, p in found])]
    return requests.withColumn("_s", F.explode(F.try_element_at(F.create_map(*args), F.col("subtype")))).select(*requests.columns, "_s.*")


def recommend(requests: DataFrame, places: DataFrame, k: int = 3, place_aff: DataFrame | None = None,
              keyword_aff: DataFrame | None = None) -> DataFrame:
    """Answers of all sources that serve each request (affinities carry ``source``)."""
    routed = route_sources(requests)
    by_distance = F.col("source") == "google_maps"
    near = rank_prominence(routed.where(by_distance).drop("source_pos"), places, k, place_aff, keyword_aff)
    popular = rank_popularity(routed.where(~by_distance).drop("source_pos"), places, k, place_aff, keyword_aff)
    columns = [*RANKED, "rank", "distance_km"]
    # the position of a source within the answer of a subtype
    order = lookup({f"{a}|{b}": p for a, b, p in P.SOURCE_ROUTES}, F.concat_ws("|", "subtype", "source"))
    return near.select(*columns).unionByName(popular.select(*columns)).withColumn("source_pos", order)


def best_across_sources(answers: DataFrame) -> DataFrame:
    """Best answer of every request; ties go to the earlier source, then the better rank."""
    row = F.struct(*[c for c in answers.columns if c != "rid"])
    best = answers.groupBy("rid").agg(F.min_by(row, F.struct((-F.col("score")).alias("a"), F.col("source_pos"), F.col("rank"))).alias("_b"))
    return best.select("rid", "_b.*")


def oracle_bonuses(agents: DataFrame, seg: dict = P.SEGMENTS) -> DataFrame:
    """True utility bonus per agent and subtype."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("subtype"), F.lit(v["utility"]).alias("base")) for s, v in seg.items()]))
    bonus = F.col("_s.base") + P.UTILITY["act_intrinsic"] * F.col("intrinsic") + P.UTILITY["act_escape"] * F.col("escape")
    return agents.withColumn("_s", rows).select(*agents.columns, F.col("_s.subtype").alias("subtype"), bonus.alias("bonus"))


def rank_oracle(requests: DataFrame, places: DataFrame, preferences: DataFrame, k: int = 5) -> DataFrame:
    """Top-k by true net utility of users with known preferences.

    ``preferences``: user_id, subtype, pref, bonus, intrinsic, pref_time,
    pref_cost, vot.
    """
    w = P.ORACLE_RANK
    candidates = pois_by_subtype(places).withColumn("root", F.col("subtype"))
    # a user's preferences of all subtypes are more rows than Spark expects of them
    asks = kept(requests.join(preferences.hint("merge"), ["user_id", "subtype"]).select(
        "rid", "user_id", "subtype", F.col("subtype").alias("root"), "lat", "lon", F.lit(max(1, k)).alias("k"), "pref", "bonus",
        (F.col("intrinsic") * w["intrinsic_weight"]).alias("own"),
        (F.col("pref_time") * F.col("vot") / max(1.0, w["speed_kmh"]) + F.col("pref_cost") * w["cost_per_km"]).alias("per_km")))
    items = drop_copies(candidates.select(
        "root", "place_id", "pos", F.col("lat").alias("south"), F.col("lon").alias("west"), F.col("lat").alias("north"),
        F.col("lon").alias("east"), F.col("rating").alias("s")), max(1, k), flat=not asks.where("abs(pref) < 1e-6").isEmpty())

    def value(s: Column) -> Column:
        return s / 5.0 * F.col("pref") + F.col("bonus") + F.col("own")

    def score(s: Column, d: Column) -> Column:
        return value(s) - F.col("per_km") * d

    d = haversine_km(F.col("lat"), F.col("lon"), F.col("i_south"), F.col("i_west"))
    # a spot holds k items at most and distance counts for more than rating: cells of places alone
    found = best_k(asks, build_tree(items), score, score(F.col("i_s"), d), sphere_bounds)
    return found.select(
        "rid", "user_id", "subtype", F.col("i_place_id").alias("place_id"), F.col("i_pos").alias("pos"), "score", "rank",
        value(F.col("i_s")).alias("v_act"), (F.col("per_km") * d).alias("c_travel"), F.lit("oracle").alias("source"))


def rank_rating_fallback(requests: DataFrame, places: DataFrame, preferences: DataFrame, k: int = 5) -> DataFrame:
    """Users without known preferences: the first k places by rating (k = 0 gives none)."""
    unknown = requests.join(preferences.select("user_id").distinct(), "user_id", "left_anti")
    items = pois_by_subtype(places).withColumn("root", F.col("subtype")).select("root", "place_id", "pos", "rating")
    head = top_per_root(items, "rating", max(0, k))
    return unknown.join(head, unknown["subtype"] == head["root"]).select(
        "rid", "user_id", "subtype", "place_id", "pos", (F.col("rating") / 5.0).alias("score"), F.col("_rn").alias("rank"), F.lit("oracle").alias("source"))


