"""CSV and JSON files.  All CSV columns are read as text and typed by projection."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns kept of a raw place file
POI_COLUMNS = ("LATITUDE", "LONGITUDE", "CITY", "LOCATION_NAME", "PLACEKEY", "NAICS_CODE", "SUB_CATEGORY", "TOP_CATEGORY")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def _blank(df: DataFrame) -> DataFrame:
    """Empty fields as empty text."""
    return df.na.fill("")


def read_poi_raw(spark: SparkSession, path: str) -> DataFrame:
    """The eight columns of a raw place file; the parser skips all others.  Empty
    fields are null."""
    return _csv(spark, path).select(*POI_COLUMNS)


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """Filtered places with numeric coordinates and their order in the file."""
    rows = _blank(_csv(spark, path)).select(
        "place_id", "name", "category", F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"))
    return rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("pos", F.monotonically_increasing_id())


def read_personas(spark: SparkSession, path: str) -> DataFrame | None:
    """Persona rows that have an id; None when there is no file."""
    try:
        rows = _blank(_csv(spark, path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.where(F.col("PersonaID") != "")


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_pois(places: DataFrame, path: str) -> None:
    """Filtered places with a fixed header, coordinates to six decimals."""
    _write_csv(places.select(
        "place_id", "name", "category", F.format_string("%.6f", "lat").alias("latitude"), F.format_string("%.6f", "lon").alias("longitude")), path)


def write_personas(personas: DataFrame, path: str) -> None:
    """Persona rows in their own column order."""
    _write_csv(personas, path)


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Small result tables as JSON lines or CSV."""
    if kind == "csv":
        _write_csv(df, path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind: {kind}")
