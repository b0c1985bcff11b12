"""Polylines held as array<struct<lat, lon>>; no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwise.functions.geo import haversine_km
from tripwise.functions.numeric import let


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


_BLOCK = 64


def running_sums(values: Column) -> Column:
    """0 and the running sums of an array of numbers.

    Appending to an array copies it, so sums run inside blocks, then over the blocks' totals:
    the work grows with the length, not its square, up to some 100,000 values.
    """
    def run(v: Column) -> Column:
        return F.aggregate(v, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(_last(acc) + x)))

    def walk(v: Column) -> Column:
        n = F.ceil(F.size(v) / _BLOCK).cast("int")
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
        blocks = F.transform(starts, lambda i: run(F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK))))
        sums = let(blocks, lambda b: F.concat(F.array(F.lit(0.0)), F.flatten(
            F.zip_with(b, F.slice(run(F.transform(b, _last)), F.lit(1), F.size(b)), lambda x, o: F.transform(F.slice(x, F.lit(2), F.lit(_BLOCK)), lambda y: y + o)))))
        return F.when(v.isNotNull(), sums)

    return let(values, walk)


def cumulative_km(path: Column) -> Column:
    """Running great-circle distance along the polyline, starting at 0."""
    def walk(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        steps = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]))
        return running_sums(steps)

    return let(path, walk)


def _lerp(path: Column, i: Column, f: Column) -> Column:
    """Point a share ``f`` of the way from vertex i-1 to vertex i (0-based)."""
    def between(a: Column, b: Column) -> Column:
        return F.struct(
            (a["lat"] + (b["lat"] - a["lat"]) * f).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * f).alias("lon"))

    return between(path[i - 1], path[i])


def _first_reaching(values: Column, target: Column) -> Column:
    """Smallest index >= 1 whose value is at least the target, else null."""
    later = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    at = F.array_position(F.transform(later, lambda v: v >= target), True)
    return F.when(at > 0, at.cast("int"))


def position_at_fraction(path: Column, cum: Column, frac: Column) -> Column:
    """Position at a share of the length; a zero-length segment gives its start."""
    given = F.struct(path.alias("p"), cum.alias("c"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac)).alias("f"))

    def aim(g: Column) -> Column:
        target = g["f"] * _last(g["c"])
        return let(F.struct(target.alias("t"), _first_reaching(g["c"], target).alias("i")), lambda x: place(g["p"], g["c"], x["t"], x["i"]))

    def place(p: Column, c: Column, target: Column, i: Column) -> Column:
        seg = c[i] - c[i - 1]
        f = F.when(seg <= 0, F.lit(0.0)).otherwise((target - c[i - 1]) / seg)
        return F.when(F.size(p) == 1, p[0]).when(i.isNull(), _last(p)).otherwise(_lerp(p, i, f))

    return let(given, aim)


def downsample(path: Column, k: int = 12) -> Column:
    """``k`` evenly spaced vertices with both ends; short polylines are unchanged."""
    def pick(p: Column) -> Column:
        step = (F.size(p) - 1).cast("double") / F.lit(float(k - 1))
        picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: p[F.bround(i.cast("double") * step, 0).cast("int")])
        return F.when(F.size(p) <= k, p).otherwise(picked)

    return let(path, pick)


def keyframe_position(path: Column, times: Column, t: Column) -> Column:
    """Piecewise-linear in time over keyframes, clamped at both ends."""
    def place(g: Column) -> Column:
        p, s, at = g["p"], g["s"], g["t"]
        i = _first_reaching(s, at)
        gap = s[i] - s[i - 1]
        f = (at - s[i - 1]) / F.when(gap == 0, F.lit(1.0)).otherwise(gap)
        return F.when(at <= s[0], p[0]).when(at >= _last(s), _last(p)).when(i.isNull(), _last(p)).otherwise(_lerp(p, i, f))

    return let(F.struct(path.alias("p"), times.alias("s"), t.cast("double").alias("t")), place)
