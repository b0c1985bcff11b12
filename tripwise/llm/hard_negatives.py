"""Hard negatives by inner product, searched in an STR-packed R-tree.

Rows become integer vectors.  The tree is a table with a row per tile: rows are dealt into
slabs by label and the coordinate that varies most (ranges of a sort, so equal rows can be
split), ordered by label and the second coordinate inside a slab and cut into tiles of equal
size; a tile is packed into leaves by two more coordinates.  Tiles and leaves hold their
minimum bounding boxes, the label being a coordinate like others.

For an anchor, a box gives an interval of inner products, coordinate by coordinate.  Anchors
take the boxes of a tile by falling upper bound (their queues advance together, so that
every leaf is multiplied with all anchors that open it at once).  A box is pruned if its interval
lies outside the score window or strictly below the anchor's k-th score so far; one that
reaches the k-th is opened, since ties go by vec_id.  Scores are exact integers.

Anchors come in blocks of a bounded number; a block is sent to all tasks, which read the tree
where it lies, and the best of each task meet by anchor.  So no tile and no row of the tree
is ever shuffled after it was built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwise.llm.common import delete_path, stored
from tripwise.session import scratch_path

#: Components stay below this, so that inner products of up to 1,024 coordinates fit 64 bits.
LARGEST = 1 << 26
#: Rows of a slab, a tile and a leaf; anchors of a block.
SLAB, TILE, LEAF = 1 << 16, 1 << 13, 1 << 8
BLOCK = 1 << 14
_NONE = np.iinfo(np.int64).min

_TILES = "n int, width int, ids binary, labels binary, vectors binary, sizes binary, lo binary, hi binary"


@dataclass(frozen=True)
class Mining:
    """Positives per anchor, negatives per positive, and the window as percentages of the positive's score."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part.

    Left out: null vec_ids and labels, null and empty vectors, vectors with null or non-finite
    components or with components of LARGEST and more once scaled, and those whose length
    differs from that of the usable row with the least vec_id.  Other columns are ignored.
    """
    vector, bound = F.col("embedding"), LARGEST / scale
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & (F.size(vector) > 0)).where(
        F.forall(vector, lambda x: x.isNotNull() & (x.cast("double") < bound) & (x.cast("double") > -bound)))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).try_cast("int"))
    told = usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), ints.alias("v"))
    dim = told.agg(F.min(F.struct("vec_id", F.size("v").alias("n")))["n"].alias("n")).first()["n"]
    return told.where(F.size("v") == (dim or 0))


def _leaves(v: np.ndarray, labels: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """Row numbers of a tile's leaves: runs of one label at a time, sliced by one coordinate, then by the next."""
    out = []
    cuts = np.flatnonzero(np.diff(labels)) + 1
    for run in np.split(np.arange(len(labels)), cuts):
        slices = max(1, round(np.sqrt(len(run) / LEAF)))
        by_first = run[np.argsort(v[run, axes[0]], kind="stable")]
        for part in np.array_split(by_first, slices):
            by_second = part[np.argsort(v[part, axes[1]], kind="stable")]
            out += np.array_split(by_second, max(1, -(-len(part) // LEAF)))
    return out


def build_tree(vectors: DataFrame, path: str) -> None:
    """Pack the rows (vec_id, label, v) into the tiles of a tree.  Equal rows count once."""
    spark = vectors.sparkSession
    head = vectors.select(F.size("v").alias("n")).limit(1).collect()
    if not head:
        spark.createDataFrame([], _TILES).write.parquet(path)
        return
    dim = head[0]["n"]
    spread = vectors.agg(F.count("*").alias("rows"), *[F.var_pop(F.col("v")[i]).alias(str(i)) for i in range(dim)]).first()
    axes = sorted(range(dim), key=lambda i: (-spread[str(i)], i))
    axes = (axes * 4)[:4]
    slabs = -(-spread["rows"] // SLAB)
    dealt = vectors.repartitionByRange(slabs, "label", F.col("v")[axes[0]], "vec_id")
    dealt = dealt.sortWithinPartitions("label", F.col("v")[axes[1]], "vec_id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def tile(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            leaves = _leaves(v, labels, axes[2:])
            order = np.concatenate(leaves)
            boxed = np.concatenate([labels[:, None], v], axis=1)
            lo, hi = np.stack([boxed[x].min(axis=0) for x in leaves]), np.stack([boxed[x].max(axis=0) for x in leaves])
            width = 2 if np.abs(v).max() < 1 << 15 else 4
            blobs = (ids[order].astype("<i8"), labels[order].astype("<i8"), v[order].astype(f"<i{width}"), np.array([len(x) for x in leaves], "<i4"), lo.astype("<i8"), hi.astype("<i8"))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(order)], pa.int32()), pa.array([width], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]],
                names=["n", "width", "ids", "labels", "vectors", "sizes", "lo", "hi"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
            v = b["v"].flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (v[1:] != v[:-1]).any(axis=1)
            if last is not None:
                new[0] = bool(ids[0] != last[0] or labels[0] != last[1] or (v[0] != last[2]).any())
            last = (ids[-1], labels[-1], v[-1])
            held.append((ids[new], labels[new], v[new]))
            size += int(new.sum())
            while size >= 2 * TILE:
                ids, labels, v = (np.concatenate(c) for c in zip(*held, strict=True))
                yield tile(ids[:TILE], labels[:TILE], v[:TILE])
                held, size = [(ids[TILE:], labels[TILE:], v[TILE:])], size - TILE
        if size:
            ids, labels, v = (np.concatenate(c) for c in zip(*held, strict=True))
            parts = -(-size // TILE)
            for rows in np.array_split(np.arange(size), parts):
                yield tile(ids[rows], labels[rows], v[rows])

    dealt.mapInArrow(pack, _TILES).write.option("compression", "zstd").parquet(path)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: through doubles where they are exact."""
    if len(a) and len(b) and a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def intervals(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any point of each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


class _Best:
    """The k best (score, vec_id) of every window, and the k-th score of those that have k."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.window, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(windows, _NONE)

    def add(self, window: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(window):
            return
        touched = np.zeros(len(self.kth), bool)
        touched[window] = True
        old = touched[self.window]
        w = np.concatenate([self.window[old], window])
        s = np.concatenate([self.score[old], score])
        v = np.concatenate([self.vec[old], vec])
        order = np.lexsort((v, -s, w))
        w, s, v = w[order], s[order], v[order]
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        place = np.arange(len(w)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(w)]])))
        full = place == self.k - 1
        self.kth[w[full]] = s[full]
        kept = place < self.k
        self.window = np.concatenate([self.window[~old], w[kept]])
        self.score = np.concatenate([self.score[~old], s[kept]])
        self.vec = np.concatenate([self.vec[~old], v[kept]])


@dataclass(frozen=True)
class _Block:
    """Anchors and, per anchor, the closed windows of scores asked for (lo > hi: none)."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    same: bool  # rows of the anchor's label, or of all others
    k: int


def _search_tile(block: _Block, best: _Best, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, sizes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    per = block.lo.shape[1]
    fits = (lo[None, :, 0] <= block.labels[:, None]) & (block.labels[:, None] <= hi[None, :, 0])
    if not block.same:
        fits = ~(fits & (lo[:, 0] == hi[:, 0])[None, :])
    anchors = np.flatnonzero(fits.any(axis=1))
    if not len(anchors):
        return
    # the tile's own box first: anchors that it can't serve go no further
    least, most = intervals(block.v[anchors], lo[:, 1:].min(axis=0)[None, :], hi[:, 1:].max(axis=0)[None, :])
    kth = best.kth.reshape(-1, per)
    open_ = ((most >= block.lo[anchors]) & (least <= block.hi[anchors]) & (most >= kth[anchors])).any(axis=1)
    anchors = anchors[open_]
    if not len(anchors):
        return
    least, most = intervals(block.v[anchors], lo[:, 1:], hi[:, 1:])
    queue = np.argsort(-most, axis=1, kind="stable")
    ends = np.cumsum(sizes)
    for step in range(queue.shape[1]):
        leaf = queue[:, step]
        at = np.arange(len(anchors))
        top, low = most[at, leaf], least[at, leaf]
        useful = (top[:, None] >= block.lo[anchors]) & (low[:, None] <= block.hi[anchors]) & (top[:, None] >= kth[anchors])
        alive = useful.any(axis=1) & fits[anchors, leaf]
        if not ((top[:, None] >= block.lo[anchors]) & (top[:, None] >= kth[anchors])).any():
            return  # boxes come by falling upper bound: none of the rest is of use
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in np.unique(leaf[alive]):
            rows = at[alive & (leaf == x)]
            own = slice(ends[x] - sizes[x], ends[x])
            q = anchors[rows]
            score = products(block.v[q], v[own])
            match = labels[own][None, :] == block.labels[q][:, None]
            if block.same:
                # an anchor is no positive of its own
                match &= ~((ids[own][None, :] == block.ids[q][:, None]) & (score == products(v[own], v[own]).diagonal()[None, :]) & (score == (block.v[q] ** 2).sum(axis=1)[:, None]))
            else:
                match = ~match
            for w in range(per):
                fit = match & (score >= np.maximum(block.lo[q, w], kth[q, w])[:, None]) & (score <= block.hi[q, w][:, None])
                if score.shape[1] > block.k and fit.sum() > 2 * block.k * len(q):
                    # no more than the leaf's own k best, ties included
                    masked = np.where(fit, score, _NONE)
                    fit &= masked >= np.partition(masked, -block.k, axis=1)[:, -block.k][:, None]
                i, j = np.nonzero(fit)
                found.append((q[i] * per + w, score[i, j], ids[own][j]))
        if found:
            best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _search(tree: DataFrame, block: _Block) -> DataFrame:
    """(window, score, vec_id): each task's best of every window; a window is anchor * windows per anchor + its number."""
    windows, dim = block.lo.size, block.v.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(windows, block.k)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b[c][i].as_py() for c in b.schema.names}
                v = np.frombuffer(r["vectors"], f"<i{r['width']}").reshape(-1, dim).astype(np.int64)
                lo, hi = (np.frombuffer(r[c], "<i8").reshape(-1, dim + 1) for c in ("lo", "hi"))
                _search_tile(block, best, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), v, np.frombuffer(r["sizes"], "<i4"), lo, hi)
        yield pa.RecordBatch.from_pydict({"window": pa.array(best.window), "score": pa.array(best.score), "vec_id": pa.array(best.vec)})

    found = tree.mapInArrow(run, "window bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.k)


_FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _mine_block(spark: SparkSession, tree: DataFrame, anchors: pa.Table, how: Mining, path: str) -> None:
    """Positives of the block's anchors, then the negatives in their windows."""
    ids, labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    v = anchors["v"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(ids), -1)
    limit = np.iinfo(np.int64).max
    first = _Block(ids, labels, v, np.full((len(ids), 1), _NONE), np.full((len(ids), 1), limit), True, how.positives)
    got = _search(tree, first).toArrow()
    anchor, place, score = got["window"].to_numpy(), got["rank"].to_numpy() - 1, got["score"].to_numpy()
    positive = np.zeros((len(ids), how.positives), np.int64)
    lo, hi = np.ones((len(ids), how.positives), np.int64), np.zeros((len(ids), how.positives), np.int64)
    positive[anchor, place] = got["vec_id"].to_numpy()
    lo[anchor, place] = -(-how.low * score // 100)
    hi[anchor, place] = how.high * score // 100
    scores = np.zeros_like(lo)
    scores[anchor, place] = score
    second = _Block(ids, labels, v, lo, hi, False, how.negatives)
    found = _search(tree, second)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, p = np.divmod(b["window"].to_numpy(), how.positives)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(positive[at, p]), b["rank"], b["vec_id"], pa.array(scores[at, p]), b["score"]],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    found.mapInArrow(name, _FOUND).write.parquet(path)


def mine(vectors: DataFrame, is_anchor: Column, how: Mining = Mining(), block: int = BLOCK) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other
    labels whose score lies in the window of the positive's score.

    ``vectors`` has (vec_id, label, v) as from ``integer_vectors``; anchors are its rows with
    ``is_anchor``.  Rows equal in all three count once; rows that share a vec_id only are
    different rows, and ties between them have no order that shows.  An anchor without
    positives, or whose windows hold no row (a negative score has an empty window), gives no rows.
    """
    spark = vectors.sparkSession
    at = scratch_path(spark, "tree")
    build_tree(vectors, at)
    tree = spark.read.schema(_TILES).parquet(at)
    # written once: a block then reads the anchors only, not all rows
    anchors = stored(vectors.where(is_anchor).distinct(), "anchors")
    path = scratch_path(spark, "negatives")
    blocks = -(-anchors.count() // block)
    numbered = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(max(1, blocks))))
    for i in range(blocks):
        part = numbered.where(F.col("block") == i).drop("block").toArrow()
        if part.num_rows:
            _mine_block(spark, tree, part, how, f"{path}/block={i}")
    if not blocks:
        spark.createDataFrame([], _FOUND).write.parquet(path)
    delete_path(spark, at)
    return spark.read.schema(_FOUND).parquet(path).drop("block")
