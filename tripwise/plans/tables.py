"""Input tables of the registered queries.

The views below turn the given tables into trips, places, users and so on.  One
text serves both engines: ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# tables whose rows carry the heavy expressions
FACTS = ("customer", "orders", "events")

VIEWS: dict[str, str] = {}

VIEWS["f_trips"] = """
SELECT o_orderkey AS trip_key, o_custkey AS agent_id,
  CASE o_orderstatus WHEN 'F' THEN 'no_rs' WHEN 'O' THEN 'standard' ELSE 'pup' END AS treatment,
  o_custkey % 5 AS seed, o_orderkey % 3 AS day, c_mktsegment AS paradigm,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'leisure' WHEN o_orderpriority = '3-MEDIUM' THEN 'work' ELSE 'home' END AS purpose,
  CASE o_orderkey % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'transit' ELSE 'car' END AS mode,
  (o_orderkey * 37) % 1320 AS depart, 5 + (o_orderkey * 13) % 50 AS travel_min,
  (o_orderkey * 37) % 1320 + 5 + (o_orderkey * 13) % 50 AS arrival,
  o_totalprice / 250000e0 AS activity_utility, ((o_orderkey * 29) % 101) * 0.08e0 AS gen_cost,
  -((o_orderkey * 29) % 101) * 0.01e0 + ((o_orderkey * 3) % 7) * 0.03e0 AS travel_utility,
  o_totalprice / 250000e0 - ((o_orderkey * 29) % 101) * 0.01e0 + ((o_orderkey * 3) % 7) * 0.03e0 - 1.1e0 AS utility,
  o_orderpriority IN ('1-URGENT','2-HIGH') AND (o_orderkey % 7) < 4 AS accepted,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN
    CASE (o_orderkey * 5) % 7 WHEN 0 THEN 'food_takeout' WHEN 1 THEN 'food_dine_in' WHEN 2 THEN 'live_music'
      WHEN 3 THEN 'workout_or_run' WHEN 4 THEN 'cafe_friend' WHEN 5 THEN 'museum' ELSE 'park' END ELSE '' END AS subtype,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') AND (o_orderkey % 7) < 4 THEN
    CASE o_orderkey % 2 WHEN 0 THEN 'google_maps' ELSE 'opentable' END ELSE 'organic' END AS source,
  (o_orderkey * 31) % (SELECT count(*) FROM {part}) AS place_id,
  ((o_orderkey * 23) % 151) * 0.1e0 AS distance_km, ((o_orderkey * 11) % 97) * 0.1e0 AS cost,
  CASE o_orderkey % 4 WHEN 2 THEN 30e0 WHEN 3 THEN 180e0 ELSE 0e0 END * ((o_orderkey * 23) % 151) * 0.1e0 AS emissions_g,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 0.05e0 + (o_orderkey % 90) * 0.01e0 ELSE 0e0 END AS eta,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') AND (o_orderkey % 7) < 4 THEN CAST((o_orderkey * 17) % 3 AS INT) - 1 ELSE -1 END AS liked
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

VIEWS["f_opportunities"] = """
SELECT trip_key, agent_id, treatment, seed, day, (trip_key % 11) < 4 AS abstained FROM {f_trips} WHERE purpose = 'leisure'
"""

VIEWS["f_places"] = """
SELECT p_partkey AS place_id, p_partkey AS pos, p_name AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'food_takeout' WHEN 'MEDIUM' THEN 'restaurant' WHEN 'PROMO' THEN 'live_music'
       WHEN 'STANDARD' THEN 'gym' WHEN 'SMALL' THEN 'cafe' ELSE 'park' END AS category,
  40.70e0 + (p_partkey % 97) * 0.001e0 AS lat, -74.02e0 + (p_partkey % 89) * 0.001e0 AS lon,
  2.8e0 + p_size * 0.042e0 AS rating, 20 + (p_partkey * 7919) % 4981 AS review_count,
  p_retailprice * 3e0 AS popularity
FROM {part}
"""

VIEWS["f_users"] = """
SELECT c_custkey AS user_id, 40.70e0 + (c_custkey % 53) * 0.00201e0 AS lat, -74.02e0 + (c_custkey % 47) * 0.00203e0 AS lon,
  c_mktsegment AS paradigm, 10e0 + c_nationkey AS vot,
  CASE c_custkey % 7 WHEN 0 THEN 'food_takeout' WHEN 1 THEN 'food_dine_in' WHEN 2 THEN 'live_music'
      WHEN 3 THEN 'workout_or_run' WHEN 4 THEN 'cafe_friend' WHEN 5 THEN 'museum' ELSE 'park' END AS subtype,
  CASE c_custkey % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'music' WHEN 2 THEN 'outdoor' ELSE 'quick' END AS interest_1,
  CASE c_custkey % 3 WHEN 0 THEN 'coffee' WHEN 1 THEN 'live' ELSE 'gym' END AS interest_2,
  0.7e0 + (c_custkey % 13) * 0.05e0 AS pref, 0.8e0 + (c_custkey % 9) * 0.05e0 AS pref_time,
  0.85e0 + (c_custkey % 8) * 0.05e0 AS pref_cost, (c_custkey % 10) * 0.04e0 AS intrinsic, (c_custkey % 6) * 0.05e0 AS escape
FROM {customer}
"""

VIEWS["f_feedback"] = """
SELECT event_id, ts, user_id, (event_id * 31) % (SELECT count(*) FROM {part}) AS place_id,
  CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' ELSE 'visit' END AS kind,
  CASE event_id % 3 WHEN 0 THEN 'opentable' ELSE 'google_maps' END AS source,
  value / 50e0 AS strength, value AS money, 5 + (event_id * 13) % 50 AS travel_min,
  ((event_id * 37) % 201 - 100) * 0.01e0 AS satisfaction
FROM {events}
"""

VIEWS["f_nodes"] = """
SELECT p_partkey AS node_id, 40.70e0 + (p_partkey % 97) * 0.001e0 + (p_partkey % 7) * 0.00003e0 AS lat,
  -74.02e0 + (p_partkey % 89) * 0.001e0 + (p_partkey % 11) * 0.00003e0 AS lon, TRUE AS is_base
FROM {part}
"""

VIEWS["f_paths"] = """
SELECT trip_key, agent_id, treatment, seed, day, mode, purpose, depart AS t0, arrival AS t1,
  40.70e0 + (trip_key % 53) * 0.002e0 AS lat0, -74.02e0 + (trip_key % 47) * 0.002e0 AS lon0,
  40.70e0 + ((trip_key * 3 + 11) % 53) * 0.002e0 AS lat1, -74.02e0 + ((trip_key * 5 + 7) % 47) * 0.002e0 AS lon1,
  2 + trip_key % 29 AS n_vertices
FROM {f_trips}
"""

# traits and stated answers of a population, one row per customer
VIEWS["f_personas"] = """
SELECT CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_name END AS PersonaID, c_custkey AS agent_id,
  CASE c_custkey % 5 WHEN 0 THEN '<35k' WHEN 1 THEN '35-75k' WHEN 2 THEN ' 75k-125k' WHEN 3 THEN '125k+' ELSE 'unknown' END AS Income,
  CASE c_custkey % 6 WHEN 0 THEN 'teen' WHEN 1 THEN 'young adult' WHEN 2 THEN 'mid adult' WHEN 3 THEN 'old adult' WHEN 4 THEN 'senior' ELSE '' END AS Age,
  CASE c_custkey % 3 WHEN 0 THEN 'own car' WHEN 1 THEN 'carshare' ELSE 'no car' END AS CarAccess,
  CASE c_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'other' END AS TransitAccess,
  CASE c_custkey % 10 WHEN 0 THEN 'ADA/wheelchair' ELSE 'none' END AS MobilityNeeds,
  CASE c_custkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS EnvConscious,
  CASE c_nationkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS RiskSalience,
  CAST(c_custkey % 61 AS STRING) AS WalkTolerance,
  CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE '' END AS Budget,
  CASE c_nationkey % 5 WHEN 0 THEN 'food' WHEN 1 THEN 'nature' WHEN 2 THEN 'nightlife' WHEN 3 THEN 'cultural' ELSE 'other' END AS PrimaryInterest,
  CASE c_custkey % 4 WHEN 0 THEN 'weekday evening' WHEN 1 THEN 'weekend afternoon' WHEN 2 THEN 'weekend morning' ELSE 'any' END AS TimeWindow,
  CASE c_custkey % 3 WHEN 0 THEN 'solo' WHEN 1 THEN 'mixed friends 20-30' ELSE 'family' END AS Group_,
  CASE c_custkey % 5 WHEN 0 THEN 'Yes' ELSE 'no' END AS TopRated,
  CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS WillingnessAI,
  CAST(40.70e0 + (c_custkey % 53) * 0.00201e0 AS STRING) AS start_latitude,
  CAST(-74.02e0 + (c_custkey % 47) * 0.00203e0 AS STRING) AS start_longitude,
  CAST(1 + c_custkey % 7 AS STRING) AS openness, CASE c_custkey % 3 WHEN 0 THEN ' ' ELSE '0.4' END AS bigfive_extraversion,
  CAST((c_custkey % 11) * 0.1e0 AS STRING) AS lv_trust_platforms,
  CASE c_custkey % 4 WHEN 0 THEN 'It depends' WHEN 1 THEN 'Option A' WHEN 2 THEN '' ELSE 'n/a' END AS q22_advice_preference,
  CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '' END AS q6_4a_review,
  CAST(c_custkey % 101 AS STRING) AS q14_spontaneity
FROM {customer}
"""

VIEWS["f_poi_raw"] = """
SELECT CASE WHEN p_partkey % 41 = 0 THEN 'abc' ELSE CAST(40.30e0 + (p_partkey % 97) * 0.008e0 AS STRING) END AS LATITUDE,
  CAST(-74.40e0 + (p_partkey % 89) * 0.010e0 AS STRING) AS LONGITUDE, 'New York' AS CITY,
  CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN ' ' || p_name ELSE p_name || '|' || p_brand || '|' || p_type END AS LOCATION_NAME,
  CASE WHEN p_partkey % 37 = 0 THEN '' ELSE 'k' || CAST(p_partkey AS STRING) || '|k' || CAST(p_partkey AS STRING) || 'b|k' || CAST(p_partkey AS STRING) || 'c' END AS PLACEKEY,
  CASE p_type WHEN 'ECONOMY' THEN '999999| 722513|722511' WHEN 'MEDIUM' THEN '722511.0' WHEN 'PROMO' THEN '111111|711130.0'
    WHEN 'STANDARD' THEN '713940' WHEN 'SMALL' THEN '' ELSE '000000' END AS NAICS_CODE,
  CASE p_type WHEN 'SMALL' THEN 'Coffee Shops' WHEN 'LARGE' THEN 'Museums' ELSE 'Other' END AS SUB_CATEGORY,
  CASE p_size % 4 WHEN 0 THEN 'Full-Service Restaurants' WHEN 1 THEN 'Nature Parks' ELSE 'Shops' END AS TOP_CATEGORY
FROM {part}
"""

# traits in [0, 1], preferences and motives of every agent
VIEWS["f_agents"] = """
SELECT c_custkey AS agent_id, 18 + c_custkey % 70 AS age, 10e0 + c_nationkey AS vot,
  CASE c_custkey % 3 WHEN 0 THEN 'own car' WHEN 1 THEN 'carshare' ELSE 'no car' END AS car_access,
  CASE c_custkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.9e0 ELSE 2.2e0 END AS car_penalty,
  CASE c_custkey % 10 WHEN 0 THEN 'ADA/wheelchair' ELSE 'none' END AS mobility_needs,
  0.25e0 + (c_custkey % 3) * 0.3e0 AS transit_level, 5 + c_custkey % 41 AS walk_tolerance,
  0.8e0 + (c_custkey % 9) * 0.05e0 AS pref_time, 0.85e0 + (c_custkey % 8) * 0.05e0 AS pref_cost,
  (c_custkey % 11) * 0.1e0 AS pref_comfort, (c_custkey % 10) * 0.1e0 AS pref_green,
  (c_custkey % 12) * 0.08e0 AS travel_affinity, (c_custkey % 14) * 0.07e0 AS status_seeking, (c_custkey % 15) * 0.06e0 AS practice_conformity,
  0.4e0 AS derived, 0.1e0 + (c_custkey % 5) * 0.05e0 AS intrinsic, (c_custkey % 6) * 0.05e0 AS escape, 0.05e0 + (c_custkey % 4) * 0.05e0 AS positionality,
  0.8e0 + (c_custkey % 9) * 0.05e0 AS feedback_sensitivity, 1.7e0 + (c_custkey % 11) * 0.1e0 AS loss_aversion,
  6e0 + (c_custkey % 10) AS satisficing_threshold, 20e0 + c_custkey % 21 AS ref_time, 2e0 + (c_custkey % 9) * 0.5e0 AS ref_cost,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'utility' WHEN 'BUILDING' THEN 'regret' WHEN 'AUTOMOBILE' THEN 'prospect' WHEN 'FURNITURE' THEN 'satisficing' ELSE 'habit' END AS paradigm,
  CASE c_custkey % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'transit' ELSE 'car' END AS habit_mode,
  CASE c_nationkey % 5 WHEN 0 THEN 'food' WHEN 1 THEN 'nature' WHEN 2 THEN 'nightlife' WHEN 3 THEN 'cultural' ELSE 'other' END AS primary_interest,
  CASE c_custkey % 4 WHEN 0 THEN 'weekday evening' WHEN 1 THEN 'weekend afternoon' WHEN 2 THEN 'weekend morning' ELSE 'any' END AS time_window,
  (c_custkey % 17) * 0.06e0 AS openness, (c_custkey % 13) * 0.08e0 AS conscientiousness, (c_custkey % 19) * 0.05e0 AS extraversion,
  (c_custkey % 23) * 0.04e0 AS agreeableness, (c_custkey % 11) * 0.09e0 AS neuroticism, (c_custkey % 21) * 0.05e0 AS maximization,
  (c_custkey % 16) * 0.06e0 AS trust_platforms, (c_custkey % 18) * 0.055e0 AS autonomy_preference, (c_custkey % 9) * 0.11e0 AS algorithmic_awareness,
  (c_custkey % 8) * 0.12e0 AS local_leisure_frequency, (c_custkey % 7) * 0.15e0 AS spontaneity_share, (c_custkey % 6) * 0.18e0 AS follow_through_platform,
  (c_custkey % 5) * 0.22e0 AS follow_through_ai, (c_custkey % 4) * 0.3e0 AS incentive_coupon, (c_custkey % 3) * 0.4e0 AS incentive_sponsored,
  (c_custkey % 2) * 0.6e0 AS incentive_loyalty, (c_custkey % 14) * 0.07e0 AS price_filter_tendency, (c_custkey % 12) * 0.08e0 AS group_coordination_preference,
  (c_custkey % 22) * 0.04e0 AS popularity_herding, (c_custkey % 24) * 0.04e0 AS unexpected_discovery, (c_custkey % 25) * 0.04e0 AS negative_recommendation_experience,
  (c_custkey % 26) * 0.03e0 AS review_posting, (c_custkey % 27) * 0.03e0 AS social_posting, (c_custkey % 28) * 0.03e0 AS switch_when_dissatisfied,
  (c_custkey % 29) * 0.03e0 AS multi_platform_parallel, (c_custkey % 31) * 0.03e0 AS advice_goal_directed, (c_custkey % 33) * 0.03e0 AS city_familiarity,
  (c_custkey % 34) * 0.02e0 AS budget_tightness, (c_custkey % 35) * 0.02e0 AS ai_itinerary_comfort
FROM {customer}
"""

_HOLE = re.compile(r"\{(\w+)\}")


class Tables:
    """The given tables and the views over them, as DataFrames built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return table
        text = VIEWS.get(f"f_{name}") or VIEWS.get(name)
        if text is None:
            return getattr(self, f"_make_{name}")()
        return self.spark.sql(text, **{hole: getattr(self, hole) for hole in set(_HOLE.findall(text))})

    def _make_edges(self) -> DataFrame:
        """Three directed edges out of every node."""
        n = self.part.agg(F.count(F.lit(1)).alias("c")).scalar()
        k = F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))
        return self.part.select("p_partkey", k.alias("k"), n.alias("n")).select(
            F.col("p_partkey").alias("u"), ((F.col("p_partkey") * 7 + F.col("k")) % F.col("n")).alias("v"), "k",
            (F.lit(10.0) + (F.col("p_partkey") * 17 + F.col("k") * 5) % 91).alias("length_m"),
        )

    def _make_streets(self) -> DataFrame:
        """Short two-way streets between consecutive nodes, with their end points."""
        nodes = self.nodes.select("node_id", "lat", "lon")
        there = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
        one_way = nodes.withColumn("v", F.col("node_id") + 1).join(there, "v").select(
            F.col("node_id").alias("u"), "v", F.lit(0).alias("k"), F.col("lat").alias("u_lat"), F.col("lon").alias("u_lon"),
            "v_lat", "v_lon", (F.lit(10.0) + (F.col("node_id") * 17) % 91).alias("length_m"),
        )
        back = one_way.select(
            F.col("v").alias("u"), F.col("u").alias("v"), "k", F.col("v_lat").alias("u_lat"), F.col("v_lon").alias("u_lon"),
            F.col("u_lat").alias("v_lat"), F.col("u_lon").alias("v_lon"), "length_m",
        )
        return one_way.unionByName(back)

    def _make_moves(self) -> DataFrame:
        """Trips with their polyline (straight lines of 2 to 30 vertices)."""
        f = F.transform(
            F.sequence(F.lit(0), (F.col("n_vertices") - 1).cast("int")),
            lambda i: F.struct(
                (F.col("lat0") + (F.col("lat1") - F.col("lat0")) * i / (F.col("n_vertices") - 1)).alias("lat"),
                (F.col("lon0") + (F.col("lon1") - F.col("lon0")) * i / (F.col("n_vertices") - 1)).alias("lon"),
            ),
        )
        return self.paths.withColumn("path", f)


DUCK_EDGES = """
SELECT p_partkey AS u, (p_partkey * 7 + s.k) % n.c AS v, s.k AS k, 10e0 + (p_partkey * 17 + s.k * 5) % 91 AS length_m
FROM part, (VALUES (1),(3),(5)) AS s(k), (SELECT count(*) AS c FROM part) n
"""
DUCK_STREETS = """
SELECT a.node_id AS u, b.node_id AS v, 0 AS k, a.lat AS u_lat, a.lon AS u_lon, b.lat AS v_lat, b.lon AS v_lon,
  10e0 + (least(a.node_id, b.node_id) * 17) % 91 AS length_m
FROM f_nodes a JOIN f_nodes b ON abs(a.node_id - b.node_id) = 1
"""
DUCK_MOVES = """
SELECT p.*, list_transform(range(0, n_vertices), lambda i: {'lat': lat0 + (lat1 - lat0) * i / (n_vertices - 1),
  'lon': lon0 + (lon1 - lon0) * i / (n_vertices - 1)}) AS path FROM f_paths p
"""


def oracle(sql: str) -> str:
    """Put the views a comparison query mentions in front of it."""
    texts = {name: _HOLE.sub(r"\1", text) for name, text in VIEWS.items()}
    texts["f_edges"], texts["f_streets"], texts["f_moves"] = DUCK_EDGES, DUCK_STREETS, DUCK_MOVES
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in texts:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(texts[name])
                needed.append(name)

    visit(sql)
    views = ",\n".join(f"{name} AS ({texts[name].strip()})" for name in needed)
    body = sql.strip()
    if not views:
        return body
    if body[:14].upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:].strip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {views},\n{body[4:].strip()}"
    return f"WITH {views}\n{body}"
