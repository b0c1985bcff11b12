"""Place catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.operators import catalog as C
from tripwise.plans.registry import query, rounded
from tripwise.plans.scalars_queries import sql_u

CODES = "CASE " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in P.NAICS_CATEGORY.items()) + " END"
TEXTS = "CASE " + " ".join(f"WHEN contains(words, '{k}') THEN '{v}'" for k, v in P.TEXT_CATEGORY) + " END"
CLASSIFY = f"""r AS (SELECT *, try_cast(LATITUDE AS DOUBLE) AS lat, try_cast(LONGITUDE AS DOUBLE) AS lon, string_split(LOCATION_NAME, '|') AS ns, string_split(PLACEKEY, '|') AS ks,
  lower(SUB_CATEGORY || ' ' || TOP_CATEGORY) AS words, row_number() OVER () AS rid FROM f_poi_raw),
 h AS (SELECT rid, min(i) AS i, min_by(cat, i) AS cat FROM (SELECT rid, i, {CODES} AS cat FROM (SELECT rid, generate_subscripts(cs, 1) AS i, split_part(trim(unnest(cs)), '.', 1) AS c
  FROM (SELECT rid, string_split(NAICS_CODE, '|') AS cs FROM r))) WHERE cat IS NOT NULL GROUP BY rid),
 k AS (SELECT trim(coalesce(ks[coalesce(h.i, 1)], ks[1])) AS place_id, trim(coalesce(ns[coalesce(h.i, 1)], ns[1])) AS name, coalesce(h.cat, {TEXTS}) AS category, lat, lon FROM r LEFT JOIN h USING (rid)),
 c AS (SELECT * FROM k WHERE category IS NOT NULL AND place_id <> '' AND name <> '')"""
INSIDE = "lat BETWEEN 40.47 AND 40.93 AND lon BETWEEN -74.30 AND -73.68"


@query("classify_poi", f"WITH {CLASSIFY} SELECT place_id, name, category FROM c")
def classify_poi(t):
    return C.classify_poi(t.poi_raw).select("place_id", "name", "category")


@query("filter_pois", f"WITH {CLASSIFY} SELECT place_id, name, category, round(lat, 6) AS lat, round(lon, 6) AS lon FROM c WHERE {INSIDE}")
def filter_pois(t):
    return rounded(C.filter_pois(t.poi_raw))


@query("poi_category_counts", f"WITH {CLASSIFY} SELECT category, count(*) AS count FROM c WHERE {INSIDE} GROUP BY category")
def poi_category_counts(t):
    return C.poi_category_counts(C.filter_pois(t.poi_raw))


def source_rows(t):
    """Places as read from a file: some ids repeat or are blank, some categories unknown."""
    return t.places.select(
        "pos", "lat", "lon",
        F.when(F.col("place_id") % 13 == 0, "").otherwise(F.concat(F.lit("p"), (F.floor(F.col("place_id") / 2)).cast("string"))).alias("place_id"),
        F.when(F.col("place_id") % 17 == 0, "").otherwise(F.col("name")).alias("name"),
        F.when(F.col("place_id") % 19 == 0, "bank").otherwise(F.concat(F.lit(" "), F.col("category"))).alias("category"),
    )


BOUNDS = (40.71, -74.015, 40.79, -73.94)
CATALOG = f"""s AS (SELECT pos, lat, lon, CASE WHEN place_id % 13 = 0 THEN '' ELSE 'p' || CAST(place_id // 2 AS VARCHAR) END AS place_id, CASE WHEN place_id % 17 = 0 THEN '' ELSE name END AS name,
  CASE WHEN place_id % 19 = 0 THEN 'bank' ELSE category END AS category FROM f_places),
 f AS (SELECT * FROM s WHERE lat BETWEEN 40.71 AND 40.79 AND lon BETWEEN -74.015 AND -73.94 AND category <> 'bank'),
 u AS (SELECT * FROM f WHERE place_id = '' UNION ALL SELECT pos, lat, lon, place_id, name, category FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY pos) AS rn FROM f WHERE place_id <> '') WHERE rn = 1),
 n AS (SELECT *, row_number() OVER (ORDER BY lead, pos) AS catalog_pos FROM (SELECT *, min(pos) OVER (PARTITION BY category) AS lead FROM u))"""
SYN = f"""round_even(2.8e0 + {sql_u('place_id', "'rating'")} * (4.9e0 - 2.8e0), 2) AS rating, 20 + CAST(floor({sql_u('place_id', "'reviews'")} * 4981) AS BIGINT) AS review_count"""
POP = f"round(greatest(10e0, review_count * (1 + {sql_u('place_id', chr(39) + 'popularity' + chr(39))} * 8)), 6)"


@query("load_catalog", f"""WITH {CATALOG}, y AS (SELECT *, {SYN} FROM n) SELECT CASE WHEN place_id = '' THEN 'poi_' || CAST(catalog_pos AS VARCHAR) ELSE place_id END AS place_id,
 CASE WHEN name = '' THEN category ELSE name END AS name, category, catalog_pos, rating, review_count, {POP} AS popularity FROM y""")
def load_catalog(t):
    return rounded(C.load_catalog(source_rows(t), BOUNDS).select("place_id", "name", "category", "catalog_pos", "rating", "review_count", "popularity"))


@query("cap_per_category", """SELECT place_id, category FROM (SELECT place_id, category, row_number() OVER (PARTITION BY category ORDER BY CAST('0x' || substr(md5(CAST(place_id AS VARCHAR) || ':20240608'), 1, 8) AS BIGINT), place_id) AS rn FROM f_places) WHERE rn <= 100""")
def cap_per_category(t):
    return C.cap_per_category(t.places, 100).select("place_id", "category")


@query("synth_prominence", f"WITH y AS (SELECT place_id, {SYN} FROM (SELECT CAST(place_id AS VARCHAR) AS place_id FROM f_places)) SELECT place_id, rating, review_count, {POP} AS popularity FROM y")
def synth_prominence(t):
    ids = t.places.select(F.col("place_id").cast("string").alias("place_id"))
    return rounded(C.synth_prominence(ids))


BRIDGE = "(VALUES " + ", ".join(f"('{s}', '{c}')" for s, cs in P.SUBTYPE_CATEGORIES.items() for c in cs) + ") b(subtype, category)"


@query("pois_by_subtype", f"SELECT subtype, place_id FROM f_places JOIN {BRIDGE} USING (category)")
def pois_by_subtype(t):
    return C.pois_by_subtype(t.places).select("subtype", "place_id")


@query("network_capacity", "SELECT greatest(60, CAST(floor(count(*) * 1.8e0) AS INT)) AS road, greatest(120, CAST(floor(count(*) * 2.5e0) AS INT)) AS transit FROM f_nodes WHERE is_base")
def network_capacity(t):
    n = t.nodes.where("is_base").agg(F.count(F.lit(1)).alias("n"))
    road, transit = C.network_capacity(F.col("n"))
    return n.select(road.alias("road"), transit.alias("transit"))
