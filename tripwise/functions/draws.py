"""Deterministic draws.

``rand()`` changes with partitioning and task retries, so every draw here is a
function of a key and a salt: the same row gets the same number on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_word(*parts: Column | str) -> Column:
    """First 32 bits of the md5 of the parts, as a long."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_uniform(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) keyed by the parts."""
    return hash_word(*parts).cast("double") / F.lit(4294967296.0)


def hash_int(lo, hi, *parts: Column | str) -> Column:
    """Uniform integer in [lo, hi] keyed by the parts."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo + F.floor(hash_uniform(*parts) * (hi - lo + 1))).cast("long")
