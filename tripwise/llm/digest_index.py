"""Exact dedup against a persistent digest index.

The index is a parquet table bucketed and sorted by digest: one row per digest with the
row that stays.  New data is hashed once, reduced to one row per digest, sort-merge
anti-joined with the index (whose side needs no shuffle) and appended.  Rows that came
first stay, so a caller that wants the longest original feeds batches by falling length.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm.common import NO_ID, SPACES
from tripwise.session import scratch_path


def squeezed(text: Column) -> Column:
    """The text without any white space of the contract; null counts as empty."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


class DigestIndex:
    """A bucketed, sorted table of (digest, keep_id, keep_row, n_chars) at a path.

    Opening an existing path continues it: bucket numbers are part of the file names.  Row
    numbers have to be new in every batch; ``next_row`` is the first free one.
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, n_chars INT"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet LOCATION '{path}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def add(self, rows: DataFrame) -> None:
        """Append the digests of (digest, doc_id, row, n_chars) that the index lacks.

        Of one digest's rows in the batch the longest original stays, then the smallest
        doc_id (null last), then the smallest row number.
        """
        best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "doc_id", "row"))
        fresh = rows.groupBy("digest").agg(best.alias("b"))
        known = self.spark.table(self.name).select("digest")
        fresh = fresh.hint("merge").join(known.hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.row").alias("keep_row"), (-F.col("b.c")).alias("n_chars"))
            # dealt by the bucket's number: one file per bucket, whatever the number of tasks
            .repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
            .write.insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def entries(self) -> DataFrame:
        """All entries, read as plain files: a join then deals both sides, so that
        a digest with many rows can be split."""
        return self.spark.read.schema(self.COLUMNS).parquet(self.path)

    def next_row(self) -> int:
        """One more than the largest row number that stayed."""
        last = self.spark.table(self.name).agg(F.max("keep_row")).first()[0]
        return 0 if last is None else last + 1

    def close(self) -> None:
        """Forget the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index_path: str | None = None, batches: int = 2, buckets: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without white space.  The row with the longest original
    stays, then the smallest doc_id; null ids sort last, and of rows that agree in all of
    this exactly one stays.  Null texts equal empty ones.  Other columns are ignored.  Every
    text is read once; all else works on digests.  ``batches`` is how many rounds, longest
    originals first, feed the index.

    With an ``index_path`` the index of earlier calls goes on: a text that it holds keeps the row
    that stayed then, whatever its length, so a copy in this call has kept = false and the
    earlier row's keep_id; group_size counts the copies of all calls.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or scratch_path(spark, "digest-index"), buckets)
    number = F.monotonically_increasing_id()
    if index_path is not None:
        number = number + index.next_row()  # apart from the rows of earlier calls
    digests = scratch_path(spark, "digests")
    text = F.coalesce("text", F.lit(""))
    (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.unhex(F.sha2(squeezed(F.col("text")), 256)).alias("digest"),
            F.char_length(text).alias("n_chars"),
        )
        # numbered once and written: later reads see the same numbers
        .withColumn("row", number)
        .write.parquet(digests)
    )
    rows = spark.read.schema("doc_id BIGINT, digest BINARY, n_chars INT, row BIGINT").parquet(digests)
    shares = [i / batches for i in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("n_chars", F.array(*map(F.lit, shares)), 1000)).first()[0] if shares else []
    high = None
    try:
        for low in [*sorted(set(cuts or []), reverse=True), None]:
            batch = rows if low is None else rows.where(F.col("n_chars") >= low)
            index.add(batch if high is None else batch.where(F.col("n_chars") < high))
            high = low
    finally:
        index.close()
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    if index_path is not None:
        # a running count: every call adds its own
        sizes.write.mode("append").parquet(f"{index_path}-sizes")
        every = spark.read.schema("digest BINARY, group_size BIGINT").parquet(f"{index_path}-sizes")
        sizes = every.join(sizes.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    known = index.entries().select("digest", "keep_id", "keep_row").join(sizes, "digest")
    # written, so that the join below has a plain exchange on both sides, which AQE can split
    told = scratch_path(spark, "kept")
    known.write.parquet(told)
    known = spark.read.schema("digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT").parquet(told)
    return rows.join(known, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
