"""Scalar math."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.  An array expression used inside
    a lambda over its own elements would otherwise be rebuilt for every element."""
    return F.transform(F.array(value), body)[0]


def clamp(v: Column | str, lo=0.0, hi=1.0) -> Column:
    """``v`` limited to [lo, hi]; null stays null (greatest/least would skip it)."""
    v = col(v)
    return F.when(v.isNotNull(), F.greatest(lit(lo), F.least(lit(hi), v)))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def half_even_round(x: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col(x), digits)


# Coefficients of the rational approximation of the normal tail
# (Hart's form as published by West), double precision.
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752)
CDF_SPLIT = 7.07106781186547
CDF_FAR = 37.0


def _horner(x: Column, coefficients) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function; neither engine has ``erf``."""
    z = col(z)
    x = F.abs(z)
    e = F.exp(-x * x / 2.0)
    near = e * _horner(x, CDF_NUM) / _horner(x, CDF_DEN)
    far = e / (x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))) / 2.506628274631
    tail = F.when(x > CDF_FAR, F.lit(0.0)).when(x < CDF_SPLIT, near).otherwise(far)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def normal_pdf(z: Column | str) -> Column:
    z = col(z)
    return F.exp(F.lit(-0.5) * z * z) / math.sqrt(2.0 * math.pi)


def minmax_value(v: Column, lo: Column, hi: Column) -> Column:
    """Min-max position of ``v``; a constant set (relative tolerance 1e-9) gives 1."""
    same = F.abs(hi - lo) <= F.lit(1e-9) * F.greatest(F.abs(hi), F.abs(lo))
    return F.when(same, F.lit(1.0)).otherwise((v - lo) / (hi - lo))


def minmax_by_group(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Min-max normalise inside each candidate set.

    The extremes come from an aggregate with map-side combine, joined back:
    one huge set is then spread over many tasks, which a window would not do.
    """
    stats = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        df.join(stats, keys)
        .withColumn(out, minmax_value(F.col(value), F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
