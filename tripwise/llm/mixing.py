"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  A document's expected number of copies is
target / source size; its whole part is taken for certain, the rest p is its inclusion
probability.  Documents are ranked by Q = odds(U) / odds(p), U a uniform draw keyed by the
document, and the ranking is taken until the words still owed to the source are reached.

The cut in the ranking is found by histograms: every source's Q line is split into cells,
the words per cell are summed, and only the cell that holds the cut is split again, so
no task ever holds or sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.llm.common import NO_ID, shielded, WORD
from tripwise.session import scratch_path

#: Cells per round of the search for the cut, as a power of two, and the rounds.
CELL_BITS = 12
ROUNDS = 3
_KEY_BITS = 52


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... by code point, null last; no task holds all sources."""
    path = scratch_path(sources.sparkSession, "ranked")
    # a global sort numbers partitions and rows; counts per partition give the offsets
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    ordered.write.parquet(path)
    ordered = sources.sparkSession.read.parquet(path)
    part = F.shiftright("_at", 33).alias("_part")
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ordered.groupBy(part).agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)
    return ordered.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part").withColumn("rank", inside + F.col("_before")).drop("_at", "_part", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Per source: source_size and target, from rows (source, size).

    Targets share the sum of all sizes by weight; a target above ``most`` times its source's
    size stops there and the excess is shared again by weight among the others, until none
    is above.  Each round is one aggregate with a single row.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(totals).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int")))
    path = scratch_path(spark, "sources")
    ranked.select("source", "source_size", "weight").write.parquet(path)
    ranked = spark.read.parquet(path)
    cap = most * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = level * F.col("weight") > cap if capped >= 0 else F.lit(False)
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("spent"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["open"] is None or row["n"] == capped:
            break
        level, capped = (float(row["all"]) - float(row["spent"] or 0.0)) / row["open"], row["n"]
    return ranked.select("source", "source_size", F.least(cap, level * F.col("weight")).alias("target"))


def _draw(seed: int, text_hash: Column) -> Column:
    """52 hash bits, keyed by the document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_hash), 64 - _KEY_BITS)


def _rank_key(draw: Column, p: Column, boost: Column) -> Column:
    """Q / (1 + Q) in 52 bits, with Q = odds(U) / odds of inclusion."""
    u = (draw + 0.5) / F.lit(float(2**_KEY_BITS))
    # null where p is 0: such a source takes whole copies only
    q = F.try_divide(u / (1 - u), p / (1 - p) * boost)
    return F.least(F.floor(q / (1 + q) * F.lit(float(2**_KEY_BITS))), F.lit(2**_KEY_BITS - 1)).cast("bigint")


@shielded("whole", "p", "last", "_src", "_hash", "_draw", "_boost")
def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 20, boost: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with _size, _source_size, _target and _copies.

    Size is the number of words (null: 0).  A source takes its target to within half of the
    last document's words.  ``boost`` (positive, default 1; over columns not named like the
    generated ones above) multiplies a document's odds of inclusion.  Rows without words take no copy beyond the certain ones of their source.  A
    null source is a source of its own.  The draw depends on seed, doc_id and text only, so
    reruns and lost tasks agree; ties are broken by doc_id, then by text hash, and rows
    equal in all of it are taken together.
    """
    spark = docs.sparkSession
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("bigint")
    numbered = docs.withColumns({
        "_size": size, "_hash": F.xxhash64(F.coalesce("text", F.lit(""))), "_boost": (F.lit(1.0) if boost is None else boost).cast("double"),
    }).withColumn("_draw", _draw(seed, F.col("_hash")))
    path = scratch_path(spark, "sizes")
    numbered.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("_size").alias("size"), F.col("_hash").alias("hash"), "_draw", "_boost",
    ).write.parquet(path)
    rows = spark.read.schema("doc_id BIGINT, source STRING, size BIGINT, hash BIGINT, _draw BIGINT, _boost DOUBLE").parquet(path)
    targets = scratch_path(spark, "targets")
    source_targets(rows, weights, float(most)).write.parquet(targets)
    targets = spark.read.schema("source STRING, source_size BIGINT, target DOUBLE").parquet(targets)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(most))
    plan = targets.withColumns({"whole": whole, "p": ratio - whole}).withColumn("owed", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = _cuts(rows, plan)
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
    plan = plan.select(F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "whole", "p", "last")
    # written: as a table of known size it is sent to the documents, which then stay in place
    told = scratch_path(spark, "plan")
    plan.write.parquet(told)
    plan = spark.read.schema(plan.schema).parquet(told)
    mixed = numbered.join(plan, F.col("source").eqNullSafe(F.col("_src")), "left")
    order = F.struct(
        _rank_key(F.col("_draw"), F.col("p"), F.col("_boost")).alias("bits"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"),
        F.col("_hash").alias("hash"))
    extra = F.when(F.col("last").isNotNull() & (F.col("_size") > 0) & (order <= F.col("last")), 1).otherwise(0)
    return mixed.withColumn("_copies", (F.col("whole") + extra).cast("bigint")).drop("_src", "whole", "p", "last", "_hash", "_draw", "_boost")


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source (``_s``): the last (bits, doc_id, hash) that the ranking takes."""
    spark = rows.sparkSession
    open_ = plan.where((F.col("p") > 0) & (F.col("owed") > 0)).select(F.col("source").alias("_s"), "p", F.col("owed").alias("_left"))
    state = open_.withColumn("_cell", F.lit(0).cast("bigint"))

    def inside(state: DataFrame, shift: int) -> DataFrame:
        drawn = rows.where("size > 0").join(state, F.col("source").eqNullSafe(F.col("_s")))
        drawn = drawn.withColumn("bits", _rank_key(F.col("_draw"), F.col("p"), F.col("_boost")))
        return drawn.where(F.shiftright("bits", shift) == F.col("_cell"))

    for r in range(ROUNDS):
        shift = _KEY_BITS - CELL_BITS * (r + 1)
        words = inside(state, shift + CELL_BITS).groupBy("_s", "p", "_left", F.shiftright("bits", shift).alias("_next")).agg(F.sum("size").alias("words"))
        by = Window.partitionBy("_s").orderBy("_next")
        running = words.withColumn("to", F.sum("words").over(by)).withColumn("from", F.col("to") - F.col("words"))
        # the cell in which the owed words are reached, else the last one
        best = running.where(F.col("from") < F.col("_left")).groupBy("_s").agg(F.max(F.struct("_next", "from", "_left", "p")).alias("b"))
        path = scratch_path(spark, "cut")
        best.select("_s", "b.p", (F.col("b._left") - F.col("b.from")).alias("_left"), F.col("b._next").alias("_cell")).write.parquet(path)
        state = spark.read.schema("_s STRING, p DOUBLE, _left DOUBLE, _cell BIGINT").parquet(path)
    shift = _KEY_BITS - CELL_BITS * ROUNDS
    last = inside(state, shift).withColumn("k", F.struct("bits", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "hash"))
    # equal keys are one step; a document counts while at least half of it is still owed
    steps = last.groupBy("_s", "_left", "_cell", "k").agg(F.sum("size").alias("size"))
    by = Window.partitionBy("_s").orderBy("k")
    steps = steps.withColumn("to", F.sum("size").over(by)).withColumn("last", F.when(F.col("to") - F.col("size") / 2 <= F.col("_left"), F.col("k")))
    before = F.struct((F.shiftleft("_cell", shift) - 1).alias("bits"), F.lit(NO_ID).alias("d"), F.lit(NO_ID).alias("hash"))
    return steps.groupBy("_s").agg(F.coalesce(F.max("last"), F.max(before)).alias("last"))
