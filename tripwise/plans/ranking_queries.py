"""Recommendation rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import ranking as R
from tripwise.operators.catalog import keywords_of, pois_by_subtype
from tripwise.plans.catalog_queries import BRIDGE
from tripwise.plans.registry import query, rounded
from tripwise.plans.scalars_queries import hav, sql_u


def q(s) -> str:
    return f"'{s}'"


def words(ws) -> str:
    return "[" + ", ".join(map(q, ws)) + "]"


def places(t):
    return t.places.withColumn("keywords", keywords_of(F.col("category")))


def requests(t):
    """One request per user, for the user's subtype."""
    return t.users.select(
        F.col("user_id").alias("rid"), "user_id", "subtype", "lat", "lon",
        F.array().cast("array<string>").alias("query_keywords"), F.array("interest_1", "interest_2").alias("interest_keywords"))


def place_affinity(t):
    """Ratings users gave, on [-1, 1]."""
    f = t.feedback.where(F.col("kind") != "visit")
    return f.groupBy("user_id", "place_id").agg(F.avg("satisfaction").alias("aff"))


def keyword_affinity(t):
    f = t.feedback.where(F.col("kind") != "visit").join(places(t).select("place_id", "keywords").hint("merge"), "place_id")
    return f.select("user_id", "satisfaction", F.explode("keywords").alias("keyword")).groupBy("user_id", "keyword").agg(
        F.avg("satisfaction").alias("aff"))


KEYS = "(VALUES " + ", ".join(f"({q(c)}, {words(ws)})" for c, ws in P.CATEGORY_KEYWORDS.items()) + ") ck(category, keywords)"
DEFAULTS = "(VALUES " + ", ".join(f"({q(s)}, {words(ws)})" for s, ws in P.SUBTYPE_KEYWORDS.items()) + ") dk(subtype, query)"
BASE = f"""pk AS (SELECT p.*, keywords FROM f_places p JOIN {KEYS} USING (category)),
 ps AS (SELECT subtype, pk.* FROM pk JOIN {BRIDGE} USING (category)),
 fa AS (SELECT user_id, place_id, avg(satisfaction) AS aff FROM f_feedback WHERE kind <> 'visit' GROUP BY ALL),
 ka AS (SELECT user_id, keyword, avg(satisfaction) AS aff FROM (SELECT user_id, satisfaction, unnest(keywords) AS keyword FROM f_feedback JOIN pk USING (place_id) WHERE kind <> 'visit') GROUP BY ALL),
 uk AS (SELECT user_id, category, sum(aff) / 3 AS kw FROM ka JOIN (SELECT category, unnest(keywords) AS keyword FROM {KEYS}) USING (keyword) GROUP BY ALL),
 pr AS (SELECT *, 0.55e0 * greatest(0e0, least(5e0, rating)) / 5 + 0.45e0 * (CASE WHEN max(l) OVER w = min(l) OVER w THEN 1e0 ELSE (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) END) AS prominence
   FROM (SELECT *, ln(1 + review_count) AS l FROM ps) WINDOW w AS (PARTITION BY subtype))"""
PERS = "greatest(0e0, least(1e0, 0.5e0 * (0.6e0 * coalesce(fa.aff, 0e0) + 0.4e0 * coalesce(uk.kw, 0e0) + 1)))"
JAC = "(len(list_intersect(keywords, {b})) / len(list_distinct(list_concat(keywords, {b}))))"
JOINS = "LEFT JOIN fa ON fa.user_id = u.user_id AND fa.place_id = x.place_id LEFT JOIN uk ON uk.user_id = u.user_id AND uk.category = x.category"
GM = f"""gm AS (SELECT u.user_id AS rid, u.subtype, x.place_id, x.pos, prominence, 0.75e0 * {JAC.format(b='query')} + 0.25e0 * {JAC.format(b='[interest_1, interest_2]')} AS relevance,
   exp(-{hav('u.lat', 'u.lon', 'x.lat', 'x.lon')} / 5) AS proximity, {PERS} AS personalization, {hav('u.lat', 'u.lon', 'x.lat', 'x.lon')} AS distance_km
   FROM f_users u JOIN pr x USING (subtype) JOIN {DEFAULTS} USING (subtype) {JOINS}),
 gs AS (SELECT *, 0.9e0 * (0.45e0 * prominence + 0.35e0 * relevance + 0.2e0 * proximity) + 0.1e0 * personalization AS score FROM gm),
 gr AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, pos) AS rank FROM gs)"""


@query("prominence", f"WITH {BASE} SELECT subtype, place_id, round(prominence, 9) AS prominence FROM pr")
def prominence(t):
    return rounded(R.prominence(pois_by_subtype(places(t))).select("subtype", "place_id", "prominence"), 9)


@query("relevance", f"""WITH {BASE} SELECT user_id, category, round(0.75e0 * {JAC.format(b='query')} + 0.25e0 * {JAC.format(b='[interest_1, interest_2]')}, 9) AS relevance
 FROM f_users JOIN {DEFAULTS} USING (subtype) JOIN {BRIDGE} USING (subtype) JOIN {KEYS} USING (category)""")
def relevance(t):
    """Relevance of the categories a user's subtype admits."""
    cats = t.users.withColumn("category", F.explode(F.try_element_at(F.create_map(*[
        c for s, cs in P.SUBTYPE_CATEGORIES.items() for c in (F.lit(s), F.array(*[F.lit(x) for x in cs if x in P.CATEGORY_KEYWORDS]))]), F.col("subtype"))))
    from tripwise.functions import normalize_tokens as n
    score = R.relevance(n(keywords_of(F.col("category"))), n(R.default_query(F.col("subtype"))), n(F.array("interest_1", "interest_2")))
    return rounded(cats.select("user_id", "category", score.alias("relevance")), 9)


@query("proximity", f"SELECT trip_key, round(exp(-{hav('lat0', 'lon0', 'lat1', 'lon1')} / 5), 9) AS proximity FROM f_paths")
def proximity(t):
    from tripwise.functions import haversine_km
    c = F.col
    return rounded(t.paths.select("trip_key", R.proximity(haversine_km(c("lat0"), c("lon0"), c("lat1"), c("lon1"))).alias("proximity")), 9)


@query("personalization", f"""WITH {BASE} SELECT u.trip_key, round({PERS}, 9) AS personalization FROM (SELECT trip_key, agent_id AS user_id, place_id FROM f_trips) u
 JOIN pk x ON x.place_id = u.place_id {JOINS}""")
def personalization(t):
    pairs = t.trips.select("trip_key", F.col("agent_id").alias("user_id"), "place_id").join(places(t).select("place_id", "keywords"), "place_id")
    return rounded(R.personalization_score(pairs, place_affinity(t), keyword_affinity(t)).select("trip_key", "personalization"), 9)


@query("rank_prominence", f"""WITH {BASE}, {GM} SELECT rid, subtype, place_id, rank, round(score, 9) AS score, round(prominence, 9) AS prominence, round(relevance, 9) AS relevance,
 round(proximity, 9) AS proximity, round(personalization, 9) AS personalization FROM gr WHERE rank <= 5""")
def rank_prominence(t):
    found = R.rank_prominence(requests(t), places(t), 5, place_affinity(t), keyword_affinity(t))
    return rounded(found.select("rid", "subtype", "place_id", "rank", "score", "prominence", "relevance", "proximity", "personalization"), 9)


POP = """po AS (SELECT *, 0.25e0 * greatest(0e0, least(5e0, rating)) / 5 + 0.35e0 * ln(1 + review_count) + 0.4e0 * ln(1 + greatest(0e0, popularity)) AS raw FROM ps),
 pn AS (SELECT *, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1e0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM po WINDOW w AS (PARTITION BY subtype))"""
OT = f"""om AS (SELECT u.user_id AS rid, u.subtype, x.place_id, x.pos, norm, {PERS} AS personalization, {hav('u.lat', 'u.lon', 'x.lat', 'x.lon')} AS distance_km FROM f_users u JOIN pn x USING (subtype) {JOINS}),
 os AS (SELECT *, 0.88e0 * norm + 0.12e0 * personalization AS score FROM om), orr AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, pos) AS rank FROM os)"""


@query("popularity_score", f"WITH {BASE}, {POP} SELECT DISTINCT place_id, round(raw, 9) AS popularity_score FROM po")
def popularity_score(t):
    return rounded(R.popularity_score(t.places).select("place_id", "popularity_score"), 9)


@query("rank_popularity", f"""WITH {BASE}, {POP}, {OT} SELECT rid, subtype, place_id, rank, round(score, 9) AS score, round(norm, 9) AS norm, round(personalization, 9) AS personalization FROM orr WHERE rank <= 5""")
def rank_popularity(t):
    found = R.rank_popularity(requests(t), places(t), 5, place_affinity(t), keyword_affinity(t))
    return rounded(found.select("rid", "subtype", "place_id", "rank", "score", "norm", "personalization"), 9)


ROUTES = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {c})" for a, b, c in P.SOURCE_ROUTES) + ") rt(subtype, source, source_pos)"
ANSWERS = f"""an AS (SELECT rid, subtype, place_id, pos, rank, score, distance_km, 'google_maps' AS source FROM gr WHERE rank <= 3 UNION ALL
  SELECT rid, subtype, place_id, pos, rank, score, distance_km, s.source FROM orr, (VALUES ('opentable'), ('spotify_ticketmaster'), ('classpass')) s(source) WHERE rank <= 3),
 ar AS (SELECT an.*, source_pos FROM an JOIN {ROUTES} USING (subtype, source))"""


@query("route_sources", f"WITH {BASE}, {POP}, {GM}, {OT}, {ANSWERS} SELECT rid, source, source_pos, rank, place_id, round(score, 9) AS score FROM ar")
def route_sources(t):
    found = recommend(t)
    return rounded(found.select("rid", "source", "source_pos", "rank", "place_id", "score"), 9)


def recommend(t):
    pa, ka = place_affinity(t), keyword_affinity(t)
    everywhere = F.explode(F.array(*[F.lit(s) for s in dict.fromkeys(s for _, s, _ in P.SOURCE_ROUTES)]))
    return R.recommend(requests(t), places(t), 3, pa.withColumn("source", everywhere), ka.withColumn("source", everywhere))


@query("best_across_sources", f"""WITH {BASE}, {POP}, {GM}, {OT}, {ANSWERS} SELECT rid, source, place_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, source_pos, rank) AS n FROM ar) WHERE n = 1""")
def best_across_sources(t):
    return rounded(R.best_across_sources(recommend(t)).select("rid", "source", "place_id", "score"), 9)


SEG = "(VALUES " + ", ".join(f"({q(s)}, {v['utility']}e0)" for s, v in P.SEGMENTS.items()) + ") sg(subtype, base)"


@query("oracle_bonuses", f"SELECT user_id, sg.subtype, round(base + 0.3e0 * intrinsic + 0.15e0 * escape, 9) AS bonus FROM f_users, {SEG}")
def oracle_bonuses(t):
    return rounded(R.oracle_bonuses(t.users.select("user_id", "intrinsic", "escape")).select("user_id", "subtype", "bonus"), 9)


def preferences(t):
    """Two thirds of the users have known preferences."""
    known = t.users.where(F.col("vot") < 26)
    return R.oracle_bonuses(known.select("user_id", "intrinsic", "escape", "pref", "pref_time", "pref_cost", "vot"))


ORACLE = f"""x AS (SELECT u.user_id AS rid, u.subtype, p.place_id, p.pos, p.rating / 5 * u.pref + (sg.base + 0.3e0 * u.intrinsic + 0.15e0 * u.escape) + u.intrinsic * 0.3e0 AS v_act,
  (u.pref_time * u.vot / 20 + u.pref_cost * 0.15e0) * {hav('u.lat', 'u.lon', 'p.lat', 'p.lon')} AS c_travel FROM f_users u JOIN {SEG} USING (subtype) JOIN (SELECT subtype, f_places.* FROM f_places JOIN {BRIDGE} USING (category)) p USING (subtype) WHERE u.vot < 26),
 r AS (SELECT *, v_act - c_travel AS score, row_number() OVER (PARTITION BY rid ORDER BY v_act - c_travel DESC, pos) AS rank FROM x)"""


@query("rank_oracle", f"WITH {ORACLE} SELECT rid, subtype, place_id, rank, round(score, 9) AS score, round(v_act, 9) AS v_act, round(c_travel, 9) AS c_travel FROM r WHERE rank <= 5")
def rank_oracle(t):
    found = R.rank_oracle(requests(t), t.places, preferences(t), 5)
    return rounded(found.select("rid", "subtype", "place_id", "rank", "score", "v_act", "c_travel"), 9)


@query("rank_rating_fallback", f"""WITH h AS (SELECT subtype, place_id, rating, row_number() OVER (PARTITION BY subtype ORDER BY rating DESC, pos) AS rank FROM f_places JOIN {BRIDGE} USING (category))
 SELECT user_id AS rid, subtype, place_id, rank, round(rating / 5, 9) AS score FROM f_users JOIN h USING (subtype) WHERE rank <= 5 AND vot >= 26""")
def rank_rating_fallback(t):
    found = R.rank_rating_fallback(requests(t), t.places, preferences(t), 5)
    return rounded(found.select("rid", "subtype", "place_id", "rank", "score"), 9)


def open_u(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0)"


def grid(x: str, span: float) -> str:
    return f"CAST(greatest(0, least(1048575, floor(({x} + {span / 2}e0) / {span}e0 * 1048576))) AS BIGINT)"


RID, SALT = "CAST(w.rid AS VARCHAR)", "'organic'"
# every cell of every request, down to the single places
ORGANIC = f"""WITH RECURSIVE g AS (SELECT subtype AS root, place_id, p.lat, p.lon, {grid('p.lat', 180.0)} AS y, {grid('p.lon', 360.0)} AS x FROM f_places p JOIN {BRIDGE} USING (category)),
 cand AS MATERIALIZED (SELECT root, place_id, lat, lon, upper({' || '.join(f"printf('%x', ((y >> {s}) & 3) * 4 + ((x >> {s}) & 3))" for s in range(18, -2, -2))} || substr(md5(CAST(place_id AS VARCHAR)), 1, 12)) AS key FROM g),
 cl AS MATERIALIZED (SELECT root, l, left(key, l) AS cell, count(*) AS n FROM cand, (SELECT CAST(range AS INT) AS l FROM range(0, 23)) GROUP BY ALL),
 ch AS MATERIALIZED (SELECT *, left(cell, l - 1) AS up, sum(n) OVER (PARTITION BY root, l, left(cell, l - 1) ORDER BY cell) AS cum FROM cl WHERE l > 0),
 w(rid, root, l, cell, n, m) AS (SELECT w.user_id, root, 0, '', n, -ln(-ln({open_u('CAST(w.user_id AS VARCHAR)', "''", SALT, "'first'")})) + ln(n) FROM f_users w JOIN cl ON root = w.subtype AND l = 0
  UNION ALL SELECT w.rid, w.root, c.l, c.cell, c.n, CASE WHEN c.n = w.n THEN w.m WHEN floor({open_u(RID, 'w.cell', SALT, "'part'")} * w.n) >= c.cum - c.n AND floor({open_u(RID, 'w.cell', SALT, "'part'")} * w.n) < c.cum THEN w.m
   ELSE -ln(exp(-w.m) - ln({open_u(RID, 'c.cell', SALT, "'largest'")}) / c.n) END FROM w JOIN ch c ON c.root = w.root AND c.l = w.l + 1 AND c.up = w.cell),
 best AS (SELECT w.rid, c.place_id, c.lat AS p_lat, c.lon AS p_lon FROM w JOIN cand c ON c.root = w.root AND c.key = w.cell JOIN f_users u ON u.user_id = w.rid
  QUALIFY row_number() OVER (PARTITION BY w.rid ORDER BY w.m - {hav('u.lat', 'u.lon', 'c.lat', 'c.lon')} / {P.ORGANIC_SCALE_KM} DESC) = 1),
 spare AS (SELECT lat, lon, row_number() OVER (ORDER BY {sql_u('CAST(node_id AS VARCHAR)', "'organic-nodes'")}, CAST(node_id AS VARCHAR)) - 1 AS i FROM f_nodes WHERE is_base),
 lost AS (SELECT user_id AS rid, floor({sql_u('CAST(user_id AS VARCHAR)', "'organic-node'")} * (SELECT count(*) FROM spare)) AS i FROM f_users WHERE subtype NOT IN (SELECT root FROM cand))
 SELECT rid, place_id, round(p_lat, 9) AS p_lat, round(p_lon, 9) AS p_lon FROM best UNION ALL SELECT rid, NULL, round(lat, 9), round(lon, 9) FROM lost JOIN spare USING (i)"""


@query("organic_choice", ORGANIC)
def organic_choice(t):
    """A keyed draw per user; tests compare its frequencies with the exact probabilities."""
    return rounded(organic_choice_of(t), 9)


def organic_choice_of(t):
    from tripwise.operators.organic import organic_choice as choose

    return choose(t.users.select(F.col("user_id").alias("rid"), "subtype", "lat", "lon"), t.places, t.nodes)
