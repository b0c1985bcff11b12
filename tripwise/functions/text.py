"""String and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwise import params as P
from tripwise.functions.numeric import clamp, col


def strip_blank(s: Column) -> Column:
    """Trim all white space, tabs and line ends included (trim takes only blanks)."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def normalize_tokens(tokens: Column) -> Column:
    """Lower-cased, stripped, distinct tokens.  Empty tokens go before the strip,
    so a blank token stays as ''."""
    kept = F.filter(tokens, lambda t: t.isNotNull() & (t != ""))
    return F.array_distinct(F.transform(kept, lambda t: strip_blank(F.lower(t))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets, 0 when either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    any_ = F.size(F.array_union(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / any_).otherwise(F.lit(0.0))


def literal_map(pairs: dict) -> Column:
    args = []
    for key, value in pairs.items():
        args += [F.lit(key), F.lit(value)]
    return F.create_map(*args)


def lookup(pairs: dict, key: Column, default=None) -> Column:
    """Value of a fixed table by key; a literal map needs no join."""
    found = F.try_element_at(literal_map(pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def coerce_unit_interval(raw: Column | str) -> Column:
    """Survey answer to [0, 1]: known words, else a number as it is, else null."""
    token = F.lower(strip_blank(col(raw).cast("string")))
    return F.when(token != "", F.coalesce(lookup(P.UNIT_TOKENS, token), token.try_cast("double")))


def normalize_score(raw: Column | str, lo: float = 1.0, hi: float = 7.0) -> Column:
    """Survey score to [0, 1]: values already there stay, others are scaled from [lo, hi]."""
    v = col(raw).try_cast("double")
    scaled = clamp((v - lo) / (hi - lo)) if hi > lo else F.lit(None).cast("double")
    return F.when((v >= 0.0) & (v <= 1.0), v).otherwise(scaled)


def first_nonempty(*columns: Column) -> Column:
    """First alias column that is neither null nor blank."""
    return F.coalesce(*[F.when(strip_blank(c) != "", c) for c in columns])


def day_minutes_label(t: Column) -> Column:
    """'Day d · HH:MM' of a minute count."""
    def two(x: Column) -> Column:
        return F.lpad(x.cast("long").cast("string"), 2, "0")

    m = F.pmod(t, F.lit(P.DAY_MINUTES))
    day = (F.floor(t / P.DAY_MINUTES) + 1).cast("string")
    return F.concat(F.lit("Day "), day, F.lit(" · "), two(F.floor(m / 60) % 24), F.lit(":"), two(F.floor(m) % 60))
