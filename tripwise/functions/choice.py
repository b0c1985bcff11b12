"""Choice sets: probabilities and weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise.functions.numeric import let


def softmax_array(values: Column) -> Column:
    """Softmax of an array (a choice set held in one row), shifted by its maximum."""
    def shares(v: Column) -> Column:
        weights = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
        return let(weights, lambda w: let(_total(w), lambda total: F.transform(w, lambda x: x / total)))

    return let(values, shares)


def _total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)


def softmax_by_group(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Softmax over a choice set spread over rows.

    Two aggregates (maximum, then the shifted sum) joined back: both combine on
    the map side, so one huge set does not end up in one task.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    shifted = df.join(top, keys).withColumn("_w", F.exp(F.col(value) - F.col("_top"))).drop("_top")
    total = shifted.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    return shifted.join(total, keys).withColumn(out, F.col("_w") / F.col("_total")).drop("_w", "_total")


def draw_index(weights: Column, u: Column) -> Column:
    """1-based index drawn in proportion to the weights: the first position whose
    running sum exceeds u times the total."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("pick"))

    def finish(acc: Column) -> Column:
        return F.when(acc["pick"] == 0, acc["i"]).otherwise(acc["pick"])

    def walk(ws: Column, target: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            s, i = acc["s"] + w, acc["i"] + 1
            pick = F.when((acc["pick"] == 0) & (s > target), i).otherwise(acc["pick"])
            return F.struct(s.alias("s"), i.alias("i"), pick.alias("pick"))

        return F.aggregate(ws, start, step, finish)

    drawn = let(weights, lambda ws: let(u * _total(ws), lambda target: walk(ws, target)))
    return F.when(F.size(weights) > 0, drawn)


def draw_option(options: Column, weights: Column, u: Column) -> Column:
    """The drawn element of ``options``."""
    return F.try_element_at(options, draw_index(weights, u))
