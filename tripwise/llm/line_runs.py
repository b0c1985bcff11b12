"""Line dedup over levelled sorted runs of line hashes.

A run is a parquet table of (h1, h2, first_doc), bucketed and sorted by the hash: the lines
that one batch of documents was first to have.  A new batch sort-merge anti-joins all runs
(their side is not shuffled), adds what is left as a run of level 0, and when a level holds
``fanout`` runs they are merged into one run of the next level.  Batches come in ascending
order of doc_id, so the run that holds a line names the smallest document that has it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm.common import ascii_lower, delete_path, NO_ID, shielded, SPACES
from tripwise.session import scratch_path

RUN = "h1 BIGINT, h2 BIGINT, first_doc BIGINT"
LINE = "doc BIGINT, text_hash BIGINT, pos INT, h1 BIGINT, h2 BIGINT"


class LineRuns:
    """The runs of one index; ``add`` takes one batch of lines (columns of ``LINE``).

    ``buckets`` is the session's number of shuffle partitions unless given: aggregates and
    joins by hash then come out bucket by bucket, and a run has one file per bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 2):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"run_{level}_{uuid.uuid4().hex}"
        (
            rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", self._folder(name)).saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self._write(merged.repartition(self.buckets, "h1", "h2"), level + 1)
                self.levels[level] = []
                for name in names:
                    self.spark.sql(f"DROP TABLE {name}")
                    delete_path(self.spark, self._folder(name))
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """Lines of the batch that an earlier document has already (columns of ``LINE``).

        All documents of the batch must come after those of earlier batches.
        """
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
        for names in self.levels:
            for name in names:
                run = self.spark.table(name).select("h1", "h2")
                fresh = fresh.hint("merge").join(run.hint("merge"), ["h1", "h2"], "left_anti")
        name = self._write(fresh, 0)
        # with the document in the key no line is hot: each (line, document) is rare
        own = self.spark.read.schema(RUN).parquet(self._folder(name)).withColumnRenamed("first_doc", "doc")
        again = scratch_path(self.spark, "again")
        lines.join(own, ["h1", "h2", "doc"], "left_anti").select("doc", "text_hash", "pos").write.parquet(again)
        self._compact()
        return self.spark.read.schema("doc BIGINT, text_hash BIGINT, pos INT").parquet(again)

    def close(self) -> None:
        """Forget the catalog entries; the files stay."""
        for names in self.levels:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


@shielded("_doc", "_text_hash", "_gone", "_lines", "_edges")
def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, buckets: int | None = None, fanout: int = 2) -> DataFrame:
    """``docs`` with _kept (text without repeated lines), _n_lines and _n_dropped.

    A line's key is the line stripped of white space with A-Z lower-cased.  Keys of at least
    ``min_chars`` code points found in two or more documents lose their lines in all but the
    smallest doc_id; lines repeated inside that document stay.  A null or empty text is one
    empty line.  Rows that share a doc_id are one document; rows without one are one last
    document.  All other columns pass through.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = (
        docs.select(doc.alias("doc"), text_hash.alias("text_hash"), F.posexplode(_parts(F.col("text"))).alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(SPACES)))
        .where(F.char_length("line") >= min_chars)
        .withColumn("line", ascii_lower(F.col("line")))
        .select("doc", "text_hash", "pos", F.xxhash64(F.lit(5), "line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"))
    )
    path = scratch_path(spark, "lines")
    lines.write.parquet(path)
    lines = spark.read.schema(LINE).parquet(path)
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.select(doc.alias("doc")).agg(F.percentile_approx("doc", F.array(*map(F.lit, shares)), 1000)).first()[0] if shares else []
    runs = LineRuns(spark, scratch_path(spark, "runs"), buckets, fanout)
    again, low = None, None
    for high in [*sorted(set(cuts or [])), None]:
        batch = lines if low is None else lines.where(F.col("doc") > low)
        dropped = runs.add(batch if high is None else batch.where(F.col("doc") <= high))
        again = dropped if again is None else again.unionByName(dropped)
        low = high
    runs.close()
    drops = again.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("_gone"))
    drops = drops.withColumnsRenamed({"doc": "_doc", "text_hash": "_text_hash"})
    joined = docs.withColumns({"_doc": doc, "_text_hash": text_hash}).join(drops, ["_doc", "_text_hash"], "left")
    joined = joined.withColumn("_lines", _parts(F.col("text")))
    gone = F.array_sort("_gone")
    # pieces between the dropped lines, so the work is linear in lines and drops
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size("_lines")))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("_edges") - 1),
        lambda i: F.slice("_lines", F.get("_edges", i - 1) + 2, F.get("_edges", i) - F.get("_edges", i - 1) - 1),
    )
    joined = joined.withColumn("_edges", edges)
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return joined.withColumns({
        "_kept": kept, "_n_lines": F.size("_lines").cast("bigint"), "_n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint"),
    }).drop("_doc", "_text_hash", "_gone", "_lines", "_edges")
