"""Street networks in GraphML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_key string, _VALUE string>>"
#: Rows of a written part: a part is read by one task.
PART_ROWS = 100_000


def _attribute(key: str | None) -> Column:
    if key is None:
        return F.lit(None).cast("string")
    return F.try_element_at(F.filter("data", lambda d: d["_key"] == key), F.lit(1))["_VALUE"]


def _line(wkt: Column) -> Column:
    """'LINESTRING (lon lat, ...)' to an array of points."""
    inner = F.regexp_extract(wkt, r"\((.*)\)", 1)
    points = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(
        F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat"), F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon")))
    return F.when(wkt.isNotNull() & (wkt != ""), points)


def _wkt(points: Column) -> Column:
    """The text that ``_line`` reads; null for no points."""
    said = F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.when(F.size(points) > 0, F.concat(F.lit("LINESTRING ("), F.array_join(said, ", "), F.lit(")")))


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lat, lon, is_base) and edges (u, v, k, length_m, geometry).

    ``path`` is a GraphML file or a folder of XML parts.  A single file is parsed by
    one task, so convert a large network to parquet once; ``write_network`` keeps its parts small.  Attribute ids differ between files; the few key declarations of the header are
    looked up first.
    """
    def tagged(tag: str):
        return spark.read.option("rowTag", tag).option("recursiveFileLookup", True)

    header = tagged("key").schema("_id string, _for string, `_attr.name` string").xml(path)
    keys = {(r[0], r[1]): r[2] for r in header.select("_for", F.col("`_attr.name`"), "_id").distinct().collect()}
    raw_nodes = tagged("node").schema(f"_id long, {_DATA}").xml(path)
    nodes = raw_nodes.select(
        F.col("_id").alias("node_id"), _attribute(keys.get(("node", "y"))).cast("double").alias("lat"),
        _attribute(keys.get(("node", "x"))).cast("double").alias("lon"), F.lit(True).alias("is_base"))
    raw_edges = tagged("edge").schema(f"_source long, _target long, _id int, {_DATA}").xml(path)
    edges = raw_edges.select(
        F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce("_id", F.lit(0)).alias("k"),
        _attribute(keys.get(("edge", "length"))).try_cast("double").alias("length_m"), _line(_attribute(keys.get(("edge", "geometry")))).alias("geometry"))
    return nodes, edges


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The same tables as well-formed XML parts (keys, nodes and edges in subfolders), points of
    an edge's line included; an edge without a line, or of a table without geometry, has none."""
    spark = nodes.sparkSession
    edges = edges if "geometry" in edges.columns else edges.withColumn("geometry", F.lit(None).cast("array<struct<lat:double,lon:double>>"))

    def data(**values: str) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("_key"), F.col(c).cast("string").alias("_VALUE")) for k, c in values.items()]).alias("data")

    def save(df: DataFrame, name: str, tag: str) -> None:
        df.write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS).option("rootTag", "graph").option("rowTag", tag).xml(f"{path}/{name}")

    keys = spark.createDataFrame([("d0", "node", "y"), ("d1", "node", "x"), ("d2", "edge", "length"), ("d3", "edge", "geometry")], "_id string, _for string, `_attr.name` string")
    save(keys, "keys", "key")
    save(nodes.select(F.col("node_id").alias("_id"), data(d0="lat", d1="lon")), "nodes", "node")
    lines = edges.withColumn("geometry", _wkt(F.col("geometry")))
    save(lines.select(F.col("u").alias("_source"), F.col("v").alias("_target"), F.col("k").alias("_id"), data(d2="length_m", d3="geometry")), "edges", "edge")
