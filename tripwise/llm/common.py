"""Helpers that the operators of this package share."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.session import scratch_path

#: The white space of all contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Java pattern of one word between that white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest id: documents without one sort after all others.
NO_ID = 2**63 - 1


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is fast and equal to that as long as it meets no other character that has
    a lower case; only texts with such a character (an accented capital, say) take the slow way.
    """
    harmless = ~c.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Z}\p{Nd}]")
    return F.when((F.octet_length(c) == F.char_length(c)) | harmless, F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_key(*columns: Column) -> list[Column]:
    """128 bits that stand for the given values: two hashes with different seeds."""
    return [F.xxhash64(F.lit(11), *columns).alias("k1"), F.xxhash64(F.lit(29), *columns).alias("k2")]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again.  A join with it deals both sides by a
    plain exchange, so that Spark can split a key with many rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(c: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(c.cast("string").cast("binary")) % folds


def shielded(*names: str) -> Callable:
    """For operators that work with generated columns: columns of the caller's first table that have
    one of these names (in any case) step aside meanwhile and come back as they were."""
    reserved = {n.lower() for n in names}

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
            aside = {c: f"_aside{i}_{c}" for i, c in enumerate(rows.columns) if c.lower() in reserved}
            if not aside:
                return f(rows, *args, **kwargs)
            return f(rows.withColumnsRenamed(aside), *args, **kwargs).withColumnsRenamed({new: old for old, new in aside.items()})

        return run

    return wrap
