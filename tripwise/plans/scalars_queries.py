"""Scalar expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import functions as X
from tripwise.plans.registry import query, rounded

BOX = (40.72, -73.99, 40.77, -73.95)


@query("in_bbox", "SELECT place_id FROM f_places WHERE lat BETWEEN 40.72 AND 40.77 AND lon BETWEEN -73.99 AND -73.95")
def in_bbox(t):
    return t.places.where(X.in_bbox(F.col("lat"), F.col("lon"), BOX)).select("place_id")


@query("bbox_overlap", """SELECT trip_key FROM f_moves WHERE NOT (list_max(list_transform(path, lambda p: p.lat)) < 40.72 OR list_min(list_transform(path, lambda p: p.lat)) > 40.77
 OR list_max(list_transform(path, lambda p: p.lon)) < -73.99 OR list_min(list_transform(path, lambda p: p.lon)) > -73.95)""")
def bbox_overlap(t):
    return t.moves.withColumn("ext", X.extent(F.col("path"))).where(X.bbox_overlap(F.col("ext"), BOX)).select("trip_key")


HAV = "2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def hav(a: str, b: str, c: str, d: str) -> str:
    return HAV.format(a=a, b=b, c=c, d=d)


@query("haversine_km", f"SELECT trip_key, round({hav('lat0', 'lon0', 'lat1', 'lon1')}, 9) AS km FROM f_paths")
def haversine_km(t):
    c = F.col
    return rounded(t.paths.select("trip_key", X.haversine_km(c("lat0"), c("lon0"), c("lat1"), c("lon1")).alias("km")), 9)


@query("clamp", "SELECT c_custkey, greatest(0e0, least(1e0, c_acctbal / 5000e0)) AS unit, greatest(-100e0, least(2000e0, c_acctbal)) AS band FROM customer")
def clamp(t):
    return t.customer.select("c_custkey", X.clamp(F.col("c_acctbal") / 5000.0).alias("unit"), X.clamp("c_acctbal", -100.0, 2000.0).alias("band"))


@query("sigmoid", "SELECT trip_key, round(1 / (1 + exp(-utility)), 9) AS p FROM f_trips")
def sigmoid(t):
    return rounded(t.trips.select("trip_key", X.sigmoid("utility").alias("p")), 9)


@query("softmax_by_group", """WITH m AS (SELECT trip_key, treatment, seed, day, exp(utility - max(utility) OVER w) AS w FROM f_trips WINDOW w AS (PARTITION BY treatment, seed, day))
 SELECT trip_key, round(w / sum(w) OVER (PARTITION BY treatment, seed, day), 9) AS p FROM m""")
def softmax_by_group(t):
    return rounded(X.softmax_by_group(t.trips, ["treatment", "seed", "day"], "utility", "p").select("trip_key", "p"), 9)


@query("minmax_by_group", """SELECT place_id, round(CASE WHEN max(v) OVER w - min(v) OVER w <= 1e-9 * greatest(abs(max(v) OVER w), abs(min(v) OVER w)) THEN 1e0
 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END, 9) AS norm FROM (SELECT place_id, category, ln(1 + review_count) AS v FROM f_places) WINDOW w AS (PARTITION BY category)""")
def minmax_by_group(t):
    places = t.places.withColumn("v", F.log1p("review_count"))
    return rounded(X.minmax_by_group(places, ["category"], "v", "norm").select("place_id", "norm"), 9)


TOKENS_SQL = """list_distinct(list_transform(list_filter([upper(split_part(p_name, ' ', 1)), ' ' || split_part(p_name, ' ', 2) || chr(9), '', ' ', p_brand, lower(p_brand)], lambda x: x <> ''),
 lambda x: regexp_replace(lower(x), '^\\s+|\\s+$', '', 'g')))"""


def token_array():
    words = F.split("p_name", " ")
    return F.array(F.upper(words[0]), F.concat(F.lit(" "), words[1], F.lit("\t")), F.lit(""), F.lit(" "), F.col("p_brand"), F.lower("p_brand"))


@query("normalize_tokens", f"SELECT p_partkey, array_to_string(list_sort({TOKENS_SQL}), '/') AS tokens FROM part")
def normalize_tokens(t):
    return t.part.select("p_partkey", F.array_join(F.array_sort(X.normalize_tokens(token_array())), "/").alias("tokens"))


@query("jaccard", """WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS a, CASE p_size % 3 WHEN 0 THEN [] WHEN 1 THEN ['red', 'bolt', 'ring'] ELSE ['blue', 'gear'] END AS b FROM part)
 SELECT p_partkey, round(CASE WHEN len(b) = 0 THEN 0e0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS score FROM x""")
def jaccard(t):
    b = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(
        F.col("p_size") % 3 == 1, F.array(*map(F.lit, ("red", "bolt", "ring")))).otherwise(F.array(F.lit("blue"), F.lit("gear")))
    return rounded(t.part.select("p_partkey", X.jaccard(F.split("p_name", " "), b).alias("score")), 9)


@query("coerce_unit_interval", """SELECT agent_id, CASE lower(trim(v)) WHEN 'yes' THEN 1e0 WHEN 'no' THEN 0e0 WHEN 'it depends' THEN 0.5e0 WHEN 'option a' THEN 1e0 WHEN 'high' THEN 0.8e0
  WHEN 'low' THEN 0.2e0 WHEN 'med' THEN 0.5e0 WHEN '' THEN NULL ELSE try_cast(trim(v) AS DOUBLE) END AS unit FROM (SELECT agent_id, unnest([q22_advice_preference, q6_4a_review, openness, WillingnessAI]) AS v FROM f_personas)""")
def coerce_unit_interval(t):
    p = t.personas.select("agent_id", F.explode(F.array("q22_advice_preference", "q6_4a_review", "openness", "WillingnessAI")).alias("v"))
    return p.select("agent_id", X.coerce_unit_interval("v").alias("unit"))


@query("normalize_score", """SELECT agent_id, round(CASE WHEN o BETWEEN 0 AND 1 THEN o ELSE greatest(0e0, least(1e0, (o - 1) / 6)) END, 9) AS likert,
 round(CASE WHEN s BETWEEN 0 AND 1 THEN s ELSE greatest(0e0, least(1e0, s / 100)) END, 9) AS percent, round(CASE WHEN a IS NULL THEN NULL WHEN a BETWEEN 0 AND 1 THEN a ELSE 0e0 END, 9) AS bad
 FROM (SELECT agent_id, try_cast(openness AS DOUBLE) AS o, try_cast(q14_spontaneity AS DOUBLE) AS s, try_cast(q22_advice_preference AS DOUBLE) AS a FROM f_personas)""")
def normalize_score(t):
    return rounded(t.personas.select(
        "agent_id", X.normalize_score("openness").alias("likert"), X.normalize_score("q14_spontaneity", 0.0, 100.0).alias("percent"),
        X.normalize_score("q22_advice_preference").alias("bad")), 9)


@query("first_nonempty", "SELECT agent_id, coalesce(nullif(trim(bigfive_extraversion), ''), nullif(trim(q6_4a_review), ''), nullif(trim(Budget), '')) AS v FROM f_personas")
def first_nonempty(t):
    return t.personas.select("agent_id", X.first_nonempty(F.col("bigfive_extraversion"), F.col("q6_4a_review"), F.col("Budget")).alias("v"))


def sql_cdf(z: str) -> str:
    from tripwise.functions.numeric import CDF_DEN, CDF_NUM

    def horner(cs):
        text = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            text = f"({text} * abs({z}) + {c!r}::DOUBLE)"
        return text

    x = f"abs({z})"
    tail = f"""CASE WHEN {x} > 37 THEN 0e0 WHEN {x} < 7.07106781186547::DOUBLE THEN exp(-{x} * {x} / 2) * {horner(CDF_NUM)} / {horner(CDF_DEN)}
     ELSE exp(-{x} * {x} / 2) / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65e0))))) / 2.506628274631e0 END"""
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


@query("normal_cdf", f"SELECT trip_key, round({sql_cdf('(utility * 4)')}, 9) AS p FROM f_trips")
def normal_cdf(t):
    return rounded(t.trips.select("trip_key", X.normal_cdf(F.col("utility") * 4).alias("p")), 9)


@query("normal_pdf", "SELECT trip_key, round(exp(-0.5e0 * utility * utility) / sqrt(2 * pi()), 9) AS density FROM f_trips")
def normal_pdf(t):
    return rounded(t.trips.select("trip_key", X.normal_pdf("utility").alias("density")), 9)


def sql_u(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296e0)"


@query("hash_uniform", f"SELECT place_id, round({sql_u('CAST(place_id AS VARCHAR)', chr(39) + 'rating' + chr(39))}, 12) AS u FROM f_places")
def hash_uniform(t):
    return rounded(t.places.select("place_id", X.hash_uniform(F.col("place_id").cast("string"), "rating").alias("u")), 12)


@query("day_minutes_label", """SELECT trip_key, 'Day ' || CAST(m // 1440 + 1 AS VARCHAR) || ' · ' || lpad(CAST(m % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS label
 FROM (SELECT trip_key, depart + day * 1440 AS m FROM f_trips)""")
def day_minutes_label(t):
    return t.trips.select("trip_key", X.day_minutes_label(F.col("depart") + F.col("day") * 1440).alias("label"))


@query("half_even_round", "SELECT trip_key, round_even(trip_key * 0.5e0, 0) AS whole, round_even(trip_key * 0.125e0, 2) AS cents FROM f_trips")
def half_even_round(t):
    return t.trips.select("trip_key", X.half_even_round(F.col("trip_key") * 0.5).alias("whole"), X.half_even_round(F.col("trip_key") * 0.125, 2).alias("cents"))
