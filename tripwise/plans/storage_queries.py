"""Round trips through the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwise import sources as S
from tripwise.operators import catalog as C
from tripwise.operators import metrics as M
from tripwise.operators import population as N
from tripwise.plans.catalog_queries import CLASSIFY, INSIDE
from tripwise.plans.metrics_queries import T1, T1S
from tripwise.plans.population_queries import personas
from tripwise.plans.registry import query, rounded
from tripwise.session import scratch_path

c = F.col


def raw_file(t) -> str:
    path = scratch_path(t.spark, "raw-places")
    t.poi_raw.withColumn("POLYGON_WKT", F.lit("POLYGON ((1 2, 3 4))")).write.option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


@query("read_poi_raw", "SELECT * REPLACE (nullif(NAICS_CODE, '') AS NAICS_CODE, nullif(PLACEKEY, '') AS PLACEKEY) FROM f_poi_raw")
def read_poi_raw(t):
    return S.read_poi_raw(t.spark, raw_file(t))


def filtered_file(t) -> str:
    path = scratch_path(t.spark, "places")
    S.write_pois(C.filter_pois(t.poi_raw), path)
    return path


@query("write_pois", f"WITH {CLASSIFY} SELECT place_id, name, category, printf('%.6f', lat) AS latitude, printf('%.6f', lon) AS longitude FROM c WHERE {INSIDE}")
def write_pois(t):
    """The file as written: fixed header, text coordinates."""
    return t.spark.read.option("header", True).csv(filtered_file(t))


@query("read_pois", f"WITH {CLASSIFY} SELECT place_id, name, category, round(lat, 6) AS lat, round(lon, 6) AS lon FROM c WHERE {INSIDE}")
def read_pois(t):
    return S.read_pois(t.spark, filtered_file(t)).drop("pos")


def persona_file(t) -> str:
    path = scratch_path(t.spark, "personas")
    S.write_personas(t.personas.withColumnRenamed("Group_", "Group").drop("agent_id"), path)
    return path


@query("read_personas", "SELECT PersonaID, Income, Budget, bigfive_extraversion, q14_spontaneity FROM f_personas WHERE PersonaID <> ''")
def read_personas(t):
    return S.read_personas(t.spark, persona_file(t)).select("PersonaID", "Income", "Budget", "bigfive_extraversion", "q14_spontaneity")


@query("write_personas", "SELECT Age, count(*) AS n, CAST(sum(CAST(WalkTolerance AS BIGINT)) AS BIGINT) AS walk FROM f_personas WHERE PersonaID <> '' GROUP BY Age")
def write_personas(t):
    """Relocated personas written and read back."""
    path = scratch_path(t.spark, "relocated")
    S.write_personas(N.relocate_personas(personas(t).drop("agent_id"), t.nodes), path)
    return S.read_personas(t.spark, path).groupBy("Age").agg(F.count(F.lit(1)).alias("n"), F.sum(c("WalkTolerance").cast("long")).alias("walk"))


@query("read_network", """SELECT a.node_id, a.lat, a.lon, n, total, n_points, round(south, 6) AS south, round(east, 6) AS east FROM f_nodes a JOIN (SELECT u, count(*) AS n, round(sum(length_m), 6) AS total,
 sum(CASE WHEN k = 1 THEN 0 ELSE 2 END) AS n_points, min(least(s.lat, d.lat)) FILTER (k <> 1) AS south, max(greatest(s.lon, d.lon)) FILTER (k <> 1) AS east
 FROM f_edges JOIN f_nodes s ON s.node_id = u JOIN f_nodes d ON d.node_id = v GROUP BY u) ON u = a.node_id""")
def read_network(t):
    """A network written and read back: nodes, and per node its edges, their lengths and lines."""
    path = scratch_path(t.spark, "network")
    # all nodes in memory are far more than their columns in a file: not to be sent
    spot = lambda name: t.nodes.select(c("node_id").alias(name), F.struct("lat", "lon").alias(f"_{name}")).hint("merge")
    lines = t.edges.join(spot("u"), "u").join(spot("v"), "v").withColumn("geometry", F.when(c("k") != 1, F.array("_u", "_v"))).drop("_u", "_v")
    S.write_network(t.nodes, lines, path)
    nodes, edges = S.read_network(t.spark, path)
    points = F.coalesce(c("geometry"), F.array().cast(edges.schema["geometry"].dataType))
    out = edges.groupBy("u").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("length_m"), 6).alias("total"), F.sum(F.size(points)).alias("n_points"),
        F.round(F.min(F.array_min(F.transform(points, lambda p: p["lat"]))), 6).alias("south"), F.round(F.max(F.array_max(F.transform(points, lambda p: p["lon"]))), 6).alias("east"))
    return nodes.join(out, c("u") == c("node_id")).select("node_id", "lat", "lon", "n", "total", "n_points", "south", "east")


@query("write_results", f"WITH {T1} {T1S}")
def write_results(t):
    path = scratch_path(t.spark, "results")
    table = rounded(M.table1_over_seeds(M.table1(t.trips, t.opportunities)))
    S.write_results(table, path)
    return t.spark.read.schema(table.schema).json(path)


@query("trips_sink", "SELECT treatment, seed, day, count(*) AS trips, round(sum(utility), 6) AS utility FROM f_trips WHERE treatment = 'standard' AND day = 2 GROUP BY ALL")
def trips_sink(t):
    path = scratch_path(t.spark, "trips")
    S.write_trips(t.trips, path)
    found = S.read_trips(t.spark, path).where((c("treatment") == "standard") & (c("day") == 2))
    return rounded(found.groupBy("treatment", c("seed").cast("long").alias("seed"), c("day").cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("utility").alias("utility")))
