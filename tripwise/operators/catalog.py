"""Place catalog: classification, filtering, caps, synthetic prominence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions import half_even_round, hash_uniform, hash_word, in_bbox, strip_blank
from tripwise.functions.text import literal_map
from tripwise.operators.ordering import ordinal


def _text(c: str, compat_nan: bool) -> Column:
    return F.coalesce(F.col(c), F.lit("nan" if compat_nan else ""))


def _at(parts: Column, i: Column) -> Column:
    """Element at 0-based ``i``, else the first one, stripped."""
    return strip_blank(F.coalesce(F.try_element_at(parts, i + 1), parts[0]))


def classify_poi(raw: DataFrame, compat_nan: bool = False) -> DataFrame:
    """Leisure category, id and name of packed source rows; other rows are dropped.

    The first industry code with a category wins and picks the name and id at its
    position; without one, an ordered key-word search over the category text
    decides.  ``compat_nan`` keeps missing cells as the text "nan".
    """
    def packed(c: str) -> Column:
        return F.split(_text(c, compat_nan), r"\|")

    codes = F.transform(packed("NAICS_CODE"), lambda c: F.split(strip_blank(c), r"\.")[0])
    table = literal_map(P.NAICS_CATEGORY)
    found = F.transform(codes, lambda c, i: F.struct(i.alias("i"), F.try_element_at(table, c).alias("category")))
    first = F.try_element_at(F.filter(found, lambda x: x["category"].isNotNull()), F.lit(1))
    words = F.lower(F.concat_ws(" ", _text("SUB_CATEGORY", compat_nan), _text("TOP_CATEGORY", compat_nan)))
    by_text = F.coalesce(*[F.when(words.contains(k), F.lit(c)) for k, c in P.TEXT_CATEGORY])
    rows = raw.withColumn("_hit", first)
    at = F.coalesce(F.col("_hit.i"), F.lit(0))
    rows = rows.withColumns({
        "place_id": _at(packed("PLACEKEY"), at), "name": _at(packed("LOCATION_NAME"), at),
        "category": F.coalesce(F.col("_hit.category"), by_text),
    }).drop("_hit")
    return rows.where(F.col("category").isNotNull() & (F.col("place_id") != "") & (F.col("name") != ""))


def with_coordinates(raw: DataFrame, lat: str = "LATITUDE", lon: str = "LONGITUDE") -> DataFrame:
    """Numeric coordinates; rows with unparsable ones are dropped."""
    rows = raw.withColumns({"lat": F.col(lat).try_cast("double"), "lon": F.col(lon).try_cast("double")})
    return rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def filter_pois(raw: DataFrame, bbox=P.POI_BBOX, compat_nan: bool = False,
                scanned: Observation | None = None, kept: Observation | None = None) -> DataFrame:
    """Source rows to leisure places in the box, one narrow stage.  The optional
    observations count rows in passing, without a second scan."""
    count = F.count(F.lit(1)).alias("rows")
    if scanned is not None:
        raw = raw.observe(scanned, count)
    inside = with_coordinates(raw).where(in_bbox(F.col("lat"), F.col("lon"), bbox))
    places = classify_poi(inside, compat_nan).select("place_id", "name", "category", "lat", "lon")
    return places.observe(kept, count) if kept is not None else places


def poi_category_counts(places: DataFrame) -> DataFrame:
    return places.groupBy("category").count().orderBy(F.desc("count"), "category")


def cap_per_category(places: DataFrame, cap: int, seed: int = P.POI_CAP_SEED) -> DataFrame:
    """Seeded sample of at most ``cap`` places per category, the same in all runs.
    The rank limit is applied before the shuffle as well, so a huge category
    sends only ``cap`` rows per task."""
    draw = Window.partitionBy("category").orderBy(hash_word(F.col("place_id"), F.lit(seed)), "place_id", "pos")
    return places.withColumn("_rn", F.row_number().over(draw)).where(F.col("_rn") <= cap).drop("_rn")


def synth_prominence(places: DataFrame) -> DataFrame:
    """Deterministic rating, review count and popularity from the place id."""
    key = F.col("place_id").cast("string")
    (r0, r1), (n0, n1), (p0, p1) = P.SYNTH["rating"], P.SYNTH["reviews"], P.SYNTH["popularity"]
    reviews = (F.lit(n0) + F.floor(hash_uniform(key, "reviews") * (n1 - n0 + 1))).cast("long")
    return places.withColumns({
        "rating": half_even_round(F.lit(r0) + hash_uniform(key, "rating") * (r1 - r0), 2), "review_count": reviews,
    }).withColumn("popularity", F.greatest(
        F.lit(P.SYNTH["popularity_floor"]), F.col("review_count") * (F.lit(p0) + hash_uniform(key, "popularity") * (p1 - p0))))


def load_catalog(pois: DataFrame, bounds, cap: int | None = None) -> DataFrame:
    """Catalog of known categories inside the network bounds.

    Ids are unique (the first row in ``pos`` order stays); rows without an id all
    stay and get ``poi_<catalog position>``.  Names fall back to the category.  All
    places are kept unless a ``cap`` per category is asked for.
    """
    rows = pois.withColumn("category", strip_blank(F.coalesce("category", F.lit(""))))
    rows = rows.where(in_bbox(F.col("lat"), F.col("lon"), bounds) & F.col("category").isin(*P.CATEGORY_KEYWORDS))
    rows = rows.withColumn("place_id", F.coalesce("place_id", F.lit("")))
    named = rows.where(F.col("place_id") != "")
    columns = [c for c in rows.columns if c != "place_id"]
    first = named.groupBy("place_id").agg(F.min_by(F.struct(*columns), "pos").alias("_r")).select("place_id", "_r.*")
    unique = first.unionByName(rows.where(F.col("place_id") == ""))
    if cap:
        unique = cap_per_category(unique, cap)
    lead = unique.groupBy("category").agg(F.min("pos").alias("_lead"))
    placed = ordinal(unique.join(lead, "category"), [], ["_lead", "pos"],
                     F.struct("_lead", F.floor(F.col("pos") / 65536).alias("part")), "catalog_pos").drop("_lead")
    key = F.when(F.col("place_id") == "", F.concat(F.lit("poi_"), F.col("catalog_pos").cast("string"))).otherwise(F.col("place_id"))
    name = F.when(F.coalesce("name", F.lit("")) == "", F.col("category")).otherwise(F.col("name"))
    # prominence is drawn from the id as read, before blank ids are named
    return synth_prominence(placed).withColumns(
        {"place_id": key, "name": name, "keywords": keywords_of(F.col("category"))})


def keywords_of(category: Column) -> Column:
    """Key words of a category; an unknown category is its own key word."""
    args = []
    for c, words in P.CATEGORY_KEYWORDS.items():
        args += [F.lit(c), F.array(*map(F.lit, words))]
    return F.coalesce(F.try_element_at(F.create_map(*args), category), F.array(category))


def pois_by_subtype(places: DataFrame) -> DataFrame:
    """One row per (subtype, place); a category may feed two subtypes.  The bridge
    is a literal map, so this is a narrow explode."""
    bridge: dict[str, list[str]] = {}
    for subtype, categories in P.SUBTYPE_CATEGORIES.items():
        for c in categories:
            bridge.setdefault(c, []).append(subtype)
    args = []
    for c, subtypes in bridge.items():
        args += [F.lit(c), F.array(*map(F.lit, subtypes))]
    return places.withColumn("subtype", F.explode(F.try_element_at(F.create_map(*args), F.col("category"))))


def network_capacity(n_nodes: Column) -> tuple[Column, Column]:
    """Road and transit capacity from the count of base nodes."""
    c = P.CAPACITY
    road = F.greatest(F.lit(c["road_floor"]), F.floor(n_nodes * c["road_mult"]).cast("int"))
    transit = F.greatest(F.lit(c["transit_floor"]), F.floor(n_nodes * c["transit_mult"]).cast("int"))
    return road, transit
