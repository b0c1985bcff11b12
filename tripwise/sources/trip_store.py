"""Trip tables kept for later queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = ("treatment", "seed", "day")


def write_trips(trips: DataFrame, path: str) -> None:
    """Parquet by treatment, seed and day; reads of one run touch only its folders.

    Rows are rebalanced by run day: large folders get as many writers as their size
    asks for, small ones share a task.
    """
    trips.hint("rebalance", *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
