"""Ordered work on groups of any size.

A window over ``partitionBy(key)`` puts a whole key into one task, which breaks
when one key holds a large share of the table.  The helpers here split a key
into consecutive chunks, work inside each chunk, and carry a small per-chunk
summary across.  ``bucket`` must be a non-decreasing function of the order
columns (a day, an hour, a coarse quantile): then chunks are consecutive, and
they are the same in every evaluation and retry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.session import cut


def _spec(keys: list[str], order: list[Column | str]):
    return Window.partitionBy(*keys).orderBy(*order)


def running_total(df: DataFrame, keys: list[str], order: list, bucket: Column, value: Column, out: str,
                  inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per key in ``order``; exclusive of the row itself if asked."""
    part = df.withColumn("_b", bucket).withColumn("_v", value)
    inside = _spec(keys + ["_b"], order).rowsBetween(Window.unboundedPreceding, 0)
    before = _spec(keys, ["_b"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        part.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
        .withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        .drop("_s")
    )
    total = F.col("_off") + F.sum("_v").over(inside)
    rows = part.join(offsets, keys + ["_b"])
    return rows.withColumn(out, total if inclusive else total - F.col("_v")).drop("_b", "_v", "_off")


def ordinal(df: DataFrame, keys: list[str], order: list, bucket: Column, out: str) -> DataFrame:
    """1-based position of each row within its key."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("long"), out)


def previous(df: DataFrame, keys: list[str], order: list, bucket: Column, value: Column, out: str) -> DataFrame:
    """``value`` of the preceding row of the key (null on the first)."""
    part = df.withColumn("_b", bucket).withColumn("_v", F.struct(value.alias("x")))
    tails = part.groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_t"))
    tails = tails.withColumn("_t", F.lag("_t").over(_spec(keys, ["_b"])))
    rows = part.join(tails, keys + ["_b"])
    seen = F.coalesce(F.lag("_v").over(_spec(keys + ["_b"], order)), F.col("_t"))
    return rows.withColumn(out, seen["x"]).drop("_b", "_v", "_t")


def chunk_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column, fields: list[Column]) -> DataFrame:
    """One row per (key, bucket) with its events as a sorted array ``events``."""
    event = F.struct(*[F.col(o) for o in order], *fields)
    return df.withColumn("_b", bucket).groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(event)).alias("events"))


#: Maps that one row of a scan holds at most, and levels above the chunks.  Buckets are whole
#: numbers; WIDTH ** (LEVELS + 1) of them in a row (hours of 1,900 years) keep to that.
WIDTH, LEVELS = 64, 3


def up_sweep(chunks: DataFrame, keys: list[str], compose: Callable[[Column, Column], Column]) -> list[DataFrame]:
    """Compose the maps ``_m`` of a key's chunks ``_b``, WIDTH consecutive buckets at a time.

    Entry 0 has a row per (key, block of buckets), each next one a row per block of blocks, the
    last a row per key: (keys, _b, _c: the parts in order with their maps, _m: their composition; no
    _b in the last).  ``compose(a, b)`` is the map that applies a, then b.
    """
    out, below = [], chunks.select(*keys, "_b", "_m")
    for level in range(LEVELS + 1):
        by = [*keys, F.floor(F.col("_b") / WIDTH).alias("_p")] if level < LEVELS else keys
        lists = below.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_b", "_m"))).alias("_c"))
        rest = F.slice("_c", F.lit(2), F.size("_c"))
        maps = F.aggregate(rest, F.element_at("_c", 1)["_m"], lambda a, x: compose(a, x["_m"]))
        below = lists.select(*keys, *([F.col("_p").alias("_b")] if level < LEVELS else []), "_c", maps.alias("_m"))
        out.append(below)
    return out


def down_sweep(levels: list[DataFrame], keys: list[str], first: Column, apply: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, _b, _v): the value every chunk starts from, ``first`` being each key's own (a
    column of the last level) and ``apply(v, m)`` the value of map m at v."""
    at = levels[-1].withColumn("_v", first)
    for level in range(LEVELS, -1, -1):
        kind = "array<struct<_b:bigint,_v:double>>"
        start = F.struct(F.col("_v").alias("v"), F.array().cast(kind).alias("out"))
        walked = F.aggregate("_c", start, lambda a, x: F.struct(
            apply(a["v"], x["_m"]).alias("v"), F.concat(a["out"], F.array(F.struct(x["_b"].alias("_b"), a["v"].alias("_v")))).alias("out")))
        parts = at.select(*keys, F.explode(walked["out"]).alias("_x")).select(*keys, "_x.*")
        at = levels[level - 1].join(parts, keys + ["_b"]) if level else parts
    return at


#: Distinct values per block, about; the number of blocks follows from their count.
BLOCK_VALUES = 100_000


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with their counts ``n`` (nulls left out), checkpointed.
    Equal values are combined before any shuffle, so ties never meet in a task."""
    return cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))


def ranked_counts(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``before``: how many rows of the key have a smaller value.

    A key is split into blocks of values at approximate quantiles, as many as the number
    of values asks for.  The edges are cut off by a checkpoint, so every reader sees the
    same ones; how good they are decides only the balance, never the result.
    """
    blocks = -(-values.count() // BLOCK_VALUES)
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        edges = cut(values.groupBy(*keys).agg(F.percentile_approx(value, shares, F.lit(max(1000, 4 * blocks))).alias("_edges")))
        values = values.join(edges, keys) if keys else values.withColumn("_edges", edges.scalar())
        block = F.size(F.filter(F.col("_edges"), lambda e: e <= F.col(value)))
    else:
        block = F.lit(0)
    ranked = running_total(values, keys, [value], block, F.col("n"), "before", inclusive=False)
    return ranked.drop("_edges")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key and share; nulls are
    left out.

    The two neighbouring ranks of each share are looked up among the distinct values with
    their counts, so equal values cost one row however many they are.
    """
    values = value_counts(df, keys, value)
    ranked = ranked_counts(values, keys, value)
    totals = values.groupBy(*keys).agg(F.sum("n").alias("_all"))
    ranked = ranked.join(totals, keys) if keys else ranked.withColumn("_all", totals.scalar())
    top = (F.col("_all") - 1).cast("double")
    wanted = F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * top).alias("place")) for s in shares])

    def weight(w: Column) -> Column:
        """Share of the two neighbouring ranks that lies among this row's equal values."""
        lo = F.floor(w["place"])
        hi = F.least(lo + 1, F.col("_all") - 1)
        held = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
        part = w["place"] - lo
        return F.when(held(lo), F.when(hi == lo, F.lit(1.0)).otherwise(1.0 - part)).otherwise(0.0) + F.when((hi > lo) & held(hi), part).otherwise(0.0)

    near = F.filter(
        F.transform(wanted, lambda w: F.struct(w["share"].alias("share"), weight(w).alias("w"))), lambda x: x["w"] > 0)
    hits = ranked.select(*keys, value, F.explode(near).alias("_h"))
    return hits.groupBy(*keys, "_h.share").agg(F.sum(F.col(value) * F.col("_h.w")).alias("percentile"))
