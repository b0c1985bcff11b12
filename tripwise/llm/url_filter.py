"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys.  Level 2 encodes the keys of the corpus that pass level
1 without being listed, level 3 the listed keys that pass level 2, and so on until no key
is wrong.  A key's first level that it fails tells its side, so membership is exact for
every key of the universe the cascade was built over, and a lookup is a column expression.

Size: level 1 uses a false positive rate of about (listed / universe), the others 1/2, so
all bits together are about listed * (1.44 * log2(universe / listed) + 5).  ``MAX_BITS``
bounds what is written into a plan; a longer list is refused with an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm.common import ascii_lower, shielded
from tripwise.session import scratch_path

MAX_BITS = 1 << 26
MAX_LEVELS = 60


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words, the number of hashes, a seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)

    def test(self, key: Column) -> Column:
        # a constant string cast to an array is folded once, whatever its length
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = F.lit(True)
        for p in positions(key, self.bits, self.hashes, self.seed):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            test = test & (F.bit_get(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return test


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Bit positions of a key, one hash per function."""
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits).cast("bigint")) for i in range(hashes)]


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Bits of all keys (column ``key``); only words of a bounded filter reach the driver."""
    wanted = max(64, math.ceil(1.44 * math.log2(1 / rate) * max(1, n)))
    if wanted > MAX_BITS:
        raise ValueError(f"a filter of {wanted} bits is beyond MAX_BITS: split the list")
    bits = 64 * math.ceil(wanted / 64)
    hashes = max(1, round(math.log2(1 / rate)))
    found = (
        keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in found:
        words[r["word"]] = r["set"]
    return Level(tuple(words), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of one universe."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Odd levels encode listed keys, even ones the false positives of the level before."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            verdict = F.when(~self.levels[i - 1].test(key), F.lit(i % 2 == 0)).otherwise(verdict)
        return verdict


def build_cascade(spark: SparkSession, listed: list[str], universe: DataFrame) -> Cascade:
    """Cascade of the listed keys over the key universe (column ``key``; repeats allowed).

    The universe is read twice (its size, then the first false positives); later levels
    read only those false positives.  An empty or null list gives a cascade without levels
    that contains nothing; keys of the list that the universe lacks are harmless.
    """
    listed = sorted({k for k in listed if k is not None})
    if not listed:
        return Cascade(())
    inside = spark.createDataFrame([(k,) for k in listed], "key string")
    universe = universe.select("key").where("key is not null")
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, len(listed) / max(1, size))
    levels = [build_level(inside, len(listed), rate, 1)]
    path = scratch_path(spark, "cascade")
    # the listed keys are told apart by value here, once; lookups use the bits only
    wrong = universe.where(levels[0].test(F.col("key"))).where(~F.col("key").isin(listed)).distinct() if len(listed) <= 100 else (
        universe.where(levels[0].test(F.col("key"))).join(inside, "key", "left_anti").distinct()
    )
    wrong.write.parquet(path)
    outside = spark.read.schema("key string").parquet(path)
    sides = [outside, inside]
    while (n := sides[0].count()) > 0:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(build_level(sides[0], n, 0.5, len(levels) + 1))
        # next: keys of the other side that pass this level too
        sides = [sides[1].where(levels[-1].test(F.col("key"))), sides[0]]
    return Cascade(tuple(levels))


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host, its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """All keys of a url that a rule of this list could have, the longest first.

    Host suffixes and path prefixes are built only in the label counts and lengths that
    rules have, so a host of thousands of labels costs no more than any other.
    """
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    labels = F.when(host == "", 0).otherwise(F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1)
    keys = [
        F.when(
            (labels >= n) & (F.char_length(path) >= size),
            F.concat(F.substring_index(host, ".", -n), F.lit("\n"), F.substring(path, 1, size) if size else F.lit("")),
        )
        for n, size in shapes
    ]
    return F.sort_array(
        F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))), asc=False
    )


@shielded("_url", "_keys", "_hit")
def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    The longest fitting rule wins (equal lengths: the later key in code point order); rows
    that no rule fits get ``default``, since none of their keys is listed.  Null urls, and
    those without ``://``, have an empty host and path and fit no rule.  Rules of an empty
    host are ignored.  Columns of the input named like the four outputs are replaced.
    """
    spark = pages.sparkSession
    rules = [r for r in rules if r.host]
    host, path = url_parts(F.col("_url"))
    parted = pages.withColumn("_url", F.col(url)).withColumns({"host": host, "path": path}).drop("_url")
    parted = parted.withColumns({"host": ascii_lower(F.col("host"))})
    parted = parted.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    if not rules:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = parted.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("_keys.k").alias("key"))
    sides = {}
    for verdict in ("allow", "block"):
        listed = [f"{r.host}\n{r.path}" for r in rules if r.verdict == verdict]
        sides[verdict] = build_cascade(spark, listed, universe)
    blocked, allowed = sides["block"], sides["allow"]
    listed = F.filter("_keys", lambda k: blocked.contains(k["k"]) | allowed.contains(k["k"]))
    hits = keyed.withColumn("_hit", F.get(listed, F.lit(0))["k"])
    return hits.withColumns({
        "rule": F.replace("_hit", F.lit("\n"), F.lit("")),
        "verdict": F.when(F.col("_hit").isNull(), F.lit(default)).when(blocked.contains(F.col("_hit")), F.lit("block")).otherwise(F.lit("allow")),
    }).drop("_keys", "_hit")
