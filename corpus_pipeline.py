"""The corpus pipeline: five stages of the training-data operators over the documents table.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
the columns of documents; the last one adds how often each document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm import line_runs, mixing, near_dup, toxicity, winnow
from tripwise.llm.common import table
from tripwise.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go; rows without text stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_documents(docs, model).where("_p_toxic < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen in an earlier document go, and n_chars follows; no row goes, a null text stays null."""
    cleaned = line_runs.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    n_chars = F.when(F.col("_n_dropped") > 0, F.char_length("_kept").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumns({"n_chars": n_chars, "text": text}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return near_dup.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark words go."""
    return winnow.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies."""
    mixed = mixing.pareto_mix(docs).where("_copies > 0")
    return mixed.select(
        *docs.columns, F.col("_copies").alias("copies"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage learns a model and the last draws by hash: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
