"""Near duplicates by a grouped prefix join, and the components of their links.

A document is its set of word shingles; two sets link when intersection / union reaches the
threshold.  In any fixed order of all shingles, linked sets share one of their first
n - ceil(t * n) + 1 shingles (the prefix).  The order is by falling rarity: counts of all
shingles of all documents are kept in hashed counters of a bounded number, and ties go by
hash.  The order steers only the work; any order finds every link.

1. One row per document: size, set digest (the node: equal sets are one), group (digest of
   prefix and size: documents with identical prefixes and size are one), prefix, and four
   minimum hashes.
2. Postings of groups, dealt once by shingle (hot shingles by parts): those met in two
   groups are shared.  Only documents of such groups, or of groups of several sets, go on.
3. Stars: per minimum hash and per group the most typical set is verified against the
   others, and the linked ones become components.  This is linear in documents however
   large a family of near copies is.
4. Group pairs that share a prefix shingle and pass the size and position filters, but lie
   in different components, are expanded to their members and verified.  Pairs inside one
   component can add nothing to it.

Sets are compared by 64-bit shingle hashes.  Links are never dropped: every pair of linked
texts is either verified or already connected by verified links.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwise.llm.common import NO_ID, shielded, stored, text_key, WORD
from tripwise.llm.hashing import mixed, pieces, shingles, word_hashes
from tripwise.session import scratch_path

#: Parameters: bounds of the number of counters (powers of two), minimum hashes per set,
#: members verified against one leader per task row group.
LEAST_BITS, MOST_BITS = 16, 25
MIN_HASHES = 4
PART = 256
#: A shingle counted more often is dealt in parts of about so many.
HOT = 4096
_CHUNK_BITS = 14


@dataclass(frozen=True)
class Likeness:
    """Words per shingle and the threshold as a whole percentage."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def document_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; empty for a text without words."""
    for first, data, offsets in pieces(texts):
        hashes, bounds, *_ = word_hashes(data, offsets)
        for r in range(len(offsets) - 1):
            own = hashes[bounds[r]:bounds[r + 1]]
            yield first + r, np.unique(shingles(own, words)) if len(own) else own


def _digest(a: np.ndarray) -> int:
    """64 bits that stand for an array, as a signed integer."""
    if not len(a):
        return 0
    spread = mixed(a + np.arange(1, len(a) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mixed(np.array([np.bitwise_xor.reduce(spread), spread.sum(dtype=np.uint64)], dtype=np.uint64) * np.uint64(len(a) * 2 + 1)).sum(dtype=np.uint64).astype(np.int64))


def shingle_levels(docs: DataFrame, like: Likeness, bits: int) -> np.ndarray:
    """Quarter-log2 levels of hashed shingle counts over all documents; 2^bits bytes."""
    chunk = min(bits, _CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for b in batches:
            held: list[np.ndarray] = []
            size = 0
            for _, s in document_sets(b["text"], like.words):
                held.append(s >> np.uint64(64 - bits))
                size += len(s)
                if size > 1 << 20:
                    np.add.at(counts, np.concatenate(held), np.uint32(1))
                    held, size = [], 0
            if size:
                np.add.at(counts, np.concatenate(held), np.uint32(1))
        for c in range(1 << (bits - chunk)):
            part = counts[c << chunk:(c + 1) << chunk]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, data in zip(b["chunk"].to_pylist(), b["counts"].to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), np.uint32)
                sums[c] = sums[c] + part if c in sums else part.astype(np.uint64)
        for c, total in sums.items():
            level = np.minimum(255, np.round(4 * np.log2(total + 1.0))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    levels = np.zeros(1 << bits, dtype=np.uint8)
    parts = max(1, min(64, 1 << (bits - chunk)))
    got = docs.select("text").mapInArrow(count, schema).repartition(parts, "chunk").mapInArrow(add, "chunk int, levels binary").toArrow()
    for c, data in zip(got["chunk"].to_pylist(), got["levels"].to_pylist(), strict=True):
        levels[c << chunk:(c + 1) << chunk] = np.frombuffer(data, np.uint8)
    return levels


_SETS = "doc_id bigint, k1 bigint, k2 bigint, n int, node bigint, gid bigint, central double, mins array<bigint>, prefix array<bigint>, parts array<int>"


def _describe(docs: DataFrame, like: Likeness, levels: np.ndarray, bits: int) -> DataFrame:
    """One row per document (columns of _SETS); the prefix comes with a group's first row in a task."""
    masks = mixed(np.arange(1, MIN_HASHES + 1, dtype=np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for _, s in document_sets(b["text"], like.words):
                n = len(s)
                if not n:
                    for c, v in zip(cols, (0, 0, 0, 0.0, None, None, None), strict=True):
                        c.append(v)
                    continue
                level = levels[s >> np.uint64(64 - bits)]
                order = np.argsort(level, kind="stable")[:like.prefix(n)]
                prefix = s[order]
                gid = _digest(np.concatenate([prefix, np.array([n], np.uint64)]))
                mins = [int(mixed(s ^ m).min().astype(np.int64)) for m in masks]
                shown, parts = None, None
                if gid not in seen:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(gid)
                    shown = prefix.astype(np.int64)
                    parts = np.maximum(1, np.exp2(level[order] / 4.0) / HOT).astype(np.int32)
                for c, v in zip(cols, (n, _digest(s), gid, float(level.mean()), mins, shown, parts), strict=True):
                    c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["k1"], b["k2"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["doc_id", "k1", "k2", "n", "node", "gid", "central", "mins", "prefix", "parts"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_key(), "text")
    return keyed.mapInArrow(rows, _SETS)


def _key() -> list[Column]:
    return text_key(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))


def _shared_postings(sets: DataFrame) -> DataFrame:
    """(sh, gid, n, pos) of prefix shingles that two groups have; hot ones are dealt in parts."""
    posted = sets.where("prefix is not null").select("gid", "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "p"))
    posted = posted.select(F.col("p.prefix").alias("sh"), "gid", "n", "pos", F.col("p.parts").alias("parts"))
    posted = posted.withColumn("part", F.when(F.col("parts") > 1, F.pmod("gid", "parts")).otherwise(0))
    by = Window.partitionBy("sh", "part")
    both = posted.withColumns({"lo": F.min("gid").over(by), "hi": F.max("gid").over(by)})
    return both.where("parts > 1 or lo < hi").select("sh", "gid", "n", "pos")


def _verified(texts: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link.  The members b of one a are checked in
    parts of about PART, each with its own copy of a, one after the other."""
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("members")), "a")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / PART).cast("bigint")))
    roles = sized.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("rank")).unionByName(
        sized.select("a", "part").distinct().select("a", "part", F.col("a").alias("node"), F.lit(0).alias("rank")))
    cast = texts.join(roles, "node").select("a", "part", "rank", "node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for b in batches:
            keys = list(zip(b["a"].to_pylist(), b["rank"].to_pylist(), b["node"].to_pylist(), strict=True))
            found: list[tuple[int, int]] = []
            for i, s in document_sets(b["text"], like.words):
                a, rank, node = keys[i]
                if rank == 0:
                    leader, own = a, s
                elif a == leader and like.linked(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s)):
                    found.append((a, node))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    dealt = cast.repartition("a", "part").sortWithinPartitions("a", "part", "rank")
    return dealt.mapInArrow(check, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star rounds; each takes the minimum of a node's
    neighbours by an aggregate and joins it back, so no list of neighbours is ever held.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # large star: neighbours above u go to the smallest of u and its neighbours
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        # small star: neighbours below u, and u itself, go to the smallest of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        small = stored(small.where("u <> v").distinct(), "edges")
        moved = small.join(edges, ["u", "v"], "left_anti").unionByName(edges.join(small, ["u", "v"], "left_anti")).limit(1).count()
        edges = small
        if not moved:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, k1, k2 (hashes of id and text), n_shingles,
    component_id and label (of the component; null without words).

    A text of fewer words than a shingle is one shingle; null texts and texts without words
    have none and are linked with nothing.  component_id is the smallest doc_id reachable by
    links, null ids left aside (null if there is no other).  Repeated rows are copies like
    any others.  Other columns are ignored.
    """
    spark = docs.sparkSession
    if bits is None:
        bits = int(min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, docs.count()))))))
    levels = shingle_levels(docs, like, bits)
    sets = stored(_describe(docs, like, levels, bits), "sets")
    shared = stored(_shared_postings(sets), "postings")
    comp = _links(spark, docs, sets, shared, like)
    labelled = sets.select("doc_id", "k1", "k2", "n", "node").join(comp.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    labelled = labelled.withColumn("label", F.coalesce("comp", "node")).drop("_node", "comp", "node")
    linked = stored(labelled.where("n > 0"), "labels")
    # written, so that the join deals both sides and a large component can be split
    least = stored(linked.groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    alone = sets.where("n = 0").select("doc_id", "k1", "k2", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("label"))
    told = linked.join(least, "label").select("doc_id", "k1", "k2", F.col("n").cast("bigint").alias("n_shingles"), "component_id", "label")
    return told.unionByName(alone)


def _links(spark: SparkSession, docs: DataFrame, sets: DataFrame, shared: DataFrame, like: Likeness) -> DataFrame:
    """(node, comp) of all nodes with links."""
    members = sets.where("n > 0").groupBy("node").agg(
        F.min(F.struct("k1", "k2")).alias("k"), F.first("gid").alias("gid"), F.first("n").alias("n"), F.first("central").alias("central"), F.first("mins").alias("mins"))
    several = sets.where("n > 0").groupBy("gid").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("gid")
    alive = shared.select("gid").unionByName(several).distinct()
    family = stored(members.join(alive, "gid").select("node", "k.k1", "k.k2", "gid", "n", "central", "mins"), "family")
    keyed = docs.select(*_key(), "text")
    texts = keyed.join(family.select("k1", "k2", "node"), ["k1", "k2"]).select("node", "text")
    # bucketed by node: both verifications find the texts in place
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.repartition(buckets, "node").write.bucketBy(buckets, "node").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    # stars around the most typical set of every minimum hash and of every group
    keys = family.select("node", "central", F.posexplode(F.concat("mins", F.array("gid"))).alias("i", "key"))
    hubs = keys.groupBy("i", "key").agg(F.max(F.struct("central", "node")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    hubs = stored(hubs, "hubs")
    stars = keys.join(hubs, ["i", "key"]).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    edges = stored(_verified(texts, stored(stars, "stars"), like), "links")
    comp = stored(components(edges), "comps")
    placed = family.join(comp, "node", "left").select("node", "gid", "n", F.coalesce("comp", "node").alias("comp"))
    placed = stored(placed, "placed")
    rest = stored(_cross_pairs(shared, placed, like), "pairs")
    more = stored(_verified(texts, rest, like), "links")
    spark.sql(f"DROP TABLE {name}")  # its files stay, as those of other scratch tables do
    return components(edges.unionByName(more))


def _cross_pairs(shared: DataFrame, placed: DataFrame, like: Likeness) -> DataFrame:
    """Candidate pairs of nodes in different components."""
    parts = placed.groupBy("gid", "comp").agg(F.first("n").alias("n"))
    posted = shared.select("sh", "gid", "pos").join(parts, "gid")
    mixed_up = posted.groupBy("sh").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sh")
    posted = stored(posted.join(mixed_up, "sh"), "postings")
    a = posted.select("sh", F.col("gid").alias("ga"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = posted.select("sh", F.col("gid").alias("gb"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    near = a.join(b, "sh").where("ca < cb").where(100 * F.least("na", "nb") >= like.percent * F.greatest("na", "nb"))
    # the first shared shingle at places pa and pb leaves at most this much to share
    near = near.where((100 + like.percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= like.percent * (F.col("na") + F.col("nb")))
    groups = near.select("ga", "ca", "gb", "cb").distinct()
    inside = parts.select(F.col("gid").alias("ga"), F.col("comp").alias("ca")).join(parts.select(F.col("gid").alias("gb"), F.col("comp").alias("cb")), F.col("ga") == F.col("gb"))
    groups = groups.unionByName(inside.where("ca < cb").select("ga", "ca", "gb", "cb"))
    left = placed.select(F.col("gid").alias("ga"), F.col("comp").alias("ca"), F.col("node").alias("a"))
    right = placed.select(F.col("gid").alias("gb"), F.col("comp").alias("cb"), F.col("node").alias("b"))
    return groups.join(left, ["ga", "ca"]).join(right, ["gb", "cb"]).select("a", "b").distinct()


@shielded("_k1", "_k2")
def distinct_documents(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs`` of which one per component stays: that of the smallest doc_id
    (null last; of repeated rows one).  Rows without words stay.  All columns as they are."""
    found = near_duplicates(docs, like).where("n_shingles > 0")
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "k1", "k2"))
    keep = found.groupBy("label").agg(best.alias("b")).select(F.col("b.k1").alias("_k1"), F.col("b.k2").alias("_k2"))
    spoken = F.coalesce("text", F.lit("")).rlike(WORD)
    keyed = docs.where(spoken).withColumns(dict(zip(("_k1", "_k2"), _key(), strict=True)))
    kept = keyed.join(keep, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select(*docs.columns)
    return kept.unionByName(docs.where(~spoken))
