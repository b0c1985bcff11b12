"""Shortest paths over nested cells of a road network.

A level is a graph cut into cells of bounded size.  Inside each cell the distances between its
border nodes are worked out once; border nodes, these distances and the edges between cells
are the next level's graph, and so on until a graph is small enough for one task.  The
tables of all levels are parquet and serve any number of searches.

A search climbs from each source: inside its cell to the borders, inside the next level's
cell to that one's borders, up to the top graph, which is searched whole; then it comes down
again, each cell being entered with the final lengths of its borders.  So there are two
steps per level, however many hops a path has, and coming down only the cells that hold
targets, or borders of such cells, are entered.

Lengths are whole numbers of 2^-36 m, so sums are exact and ties mean the same at every
level; of equally long paths the one of fewer hops counts, so predecessors never form a circle.
A graph that cells don't separate (its neighbourhoods are crowded, or its borders are most of
it) has short paths: its top graph is searched by rounds of relaxation instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwise.session import kept, scratch_path

UNIT = 2.0**36
#: Nodes of a cell; edges of a graph that one task searches; sources searched by a task at a time.
CELL, TOP_EDGES, SOURCES = 1024, 400_000, 64
#: A cut is of use if the borders are at most this share of the nodes.
WORTH = 0.5
#: Nodes of a shard in rounds of relaxation, about; length of what is not reached.
SHARD, FAR = 1 << 15, np.int64((1 << 63) - 1)
#: Mean edges that a round's limit lies above the nearest open entry; how far sums may be off to count as equal.
AHEAD, OFF = 3, 1e-6 * UNIT
#: Where the neighbourhoods of most probed nodes hold so many nodes within so many hops, cells aren't tried.
PROBES, CROWD, HOPS = 5, 16 * CELL, 12


# ------------------------------------------------------------------- one cell
def adjacency(edges: pd.DataFrame) -> dict:
    out: dict = {}
    for u, v, w, hops, last in zip(edges["u"], edges["v"], edges["w"], edges["hops"], edges["last"], strict=True):
        out.setdefault(u, []).append((v, w, hops, last))
    return out


def settle(out: dict, starts: Iterable[tuple], wanted: set | None = None) -> dict:
    """node: (length, hops, predecessor) from given (length, hops, node, predecessor) rows.

    Stops when all ``wanted`` nodes are settled."""
    best: dict = {}
    heap: list[tuple] = []
    for d, h, node, pred in starts:
        if node not in best or (d, h) < best[node][:2]:
            best[node] = (d, h, pred)
            heap.append((d, h, node))
    heapq.heapify(heap)
    left = None if wanted is None else set(wanted)
    done = set()
    while heap:
        d, h, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if left is not None:
            left.discard(node)
            if not left:
                break
        for v, w, hops, last in out.get(node, ()):
            nd, nh = d + w, h + hops
            if v not in done and (v not in best or (nd, nh) < best[v][:2]):
                best[v] = (nd, nh, last)
                heapq.heappush(heap, (nd, nh, v))
    return best if left is None else {n: r for n, r in best.items() if n in done}


# ------------------------------------------------------------------- building
def grow_cells(edges: DataFrame, limit: int) -> DataFrame:
    """(node, cell): connected cells of at most ``limit`` nodes.

    Rounds of star contraction: by a coin of the round some cells stay and the others join the
    neighbour they have most edges with, as long as the sizes allow.  The number of rounds
    grows with the log of the limit; it ends when a round joins hardly any cell.
    """
    links = edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    links = kept(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    labels = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    labels = kept(labels.withColumn("cell", F.col("node")))
    cells = labels.count()
    idle = rounds = 0
    while idle < 2:
        rounds += 1
        sizes = labels.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        coin = lambda c: F.pmod(F.xxhash64(F.lit(rounds), c), F.lit(2))  # noqa: E731, B023
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).where((coin(F.col("a")) == 1) & (coin(F.col("b")) == 0))
        asked = both.join(sizes.select(F.col("cell").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("cell").alias("b"), F.col("size").alias("sb")), "b")
        asked = asked.where(F.col("sa") + F.col("sb") <= limit)
        best = asked.groupBy("a").agg(F.max_by(F.struct("b", "sa", "sb"), F.struct("n", -F.col("sb"), F.xxhash64("b"))).alias("x")).select("a", "x.*")
        room = F.sum("sa").over(Window.partitionBy("b").orderBy("sa", "a").rowsBetween(Window.unboundedPreceding, 0)) + F.col("sb")
        joined = kept(best.withColumn("room", room).where(F.col("room") <= limit).select("a", "b"))
        n = joined.count()
        idle = idle + 1 if n < 0.1 * cells else 0
        cells -= n
        if not n:
            continue
        moved = lambda df, c: df.join(joined.select(F.col("a").alias(c), F.col("b").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: E731, B023
        labels = kept(moved(labels, "cell").select("node", "cell"))
        ends = moved(moved(links, "a"), "b").where("a <> b")
        links = kept(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n")))
    return labels


def crowded(edges: DataFrame) -> bool:
    """Are most neighbourhoods so large that no cut leaves few borders?  Looks around a few nodes
    of small hash, both ways along the edges; it only chooses between two exact searches."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = kept(edges.groupBy("u").agg(F.min(F.xxhash64("u")).alias("h")).orderBy("h", "u").limit(PROBES).select(F.col("u").alias("root"), F.col("u").alias("node"), F.lit(0).alias("hop")))
    for hop in range(1, HOPS + 1):
        sizes = sorted(r["n"] for r in seen.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect())
        if sizes and sizes[len(sizes) // 2] >= CROWD:
            return True
        rim = seen.where(F.col("hop") == hop - 1).select("root", F.col("node").alias("u"))
        met = both.join(F.broadcast(rim), "u").select("root", F.col("v").alias("node"), F.lit(hop).alias("hop"))
        seen = kept(seen.unionByName(met).groupBy("root", "node").agg(F.min("hop").alias("hop")))
    return False


@dataclass(frozen=True)
class Overlay:
    """Stored levels: ``folder/cells=<l>`` (node, cell, border) and ``folder/inner=<l>`` (cell, u, v,
    w, hops, last) below the top, ``folder/top`` (u, v, w, hops, last)."""

    spark: SparkSession
    folder: str
    levels: int
    small: bool  # the top graph fits a task

    def cells(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells={level}")

    def inner(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/inner={level}")

    def top(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/top")


def build_overlay(edges: DataFrame, folder: str | None = None, cells: DataFrame | None = None) -> Overlay:
    """Levels of the directed edges (u, v, length_m; a null length is 1, lengths are 0 or more
    and paths shorter than 130,000 km; loops are ignored).

    ``cells`` (node, cell) may give the first level's cells, from coordinates say; cells that
    are not given are grown from the edges.  Jobs run while the levels are built.
    """
    spark = edges.sparkSession
    folder = folder or scratch_path(spark, "overlay")
    short = edges.where("u <> v").groupBy("u", "v").agg(F.min(F.coalesce("length_m", F.lit(1.0))).alias("m"))
    graph = kept(short.select("u", "v", F.round(F.col("m") * UNIT).cast("bigint").alias("w"), F.lit(1).cast("bigint").alias("hops"), F.col("u").alias("last")))
    kind = graph.schema["u"].dataType.simpleString()
    level = 0
    while (n_edges := graph.count()) > TOP_EDGES:
        given = level == 0 and cells is not None
        if not given and crowded(graph):
            break
        labels = cells if given else grow_cells(graph, CELL)
        known = labels.select("node", F.col("cell").alias("c"))
        ends = graph.join(known.withColumnsRenamed({"node": "u", "c": "cu"}), "u").join(known.withColumnsRenamed({"node": "v", "c": "cv"}), "v")
        ends = kept(ends)
        between = ends.where("cu <> cv").select("u", "v", "w", "hops", "last")
        border = between.select(F.col("u").alias("node")).unionByName(between.select(F.col("v").alias("node"))).distinct().withColumn("border", F.lit(True))
        placed = kept(labels.select("node", "cell").join(border, "node", "left").withColumn("border", F.coalesce("border", F.lit(False))))
        n, m = placed.agg(F.count(F.lit(1)), F.sum(F.col("border").cast("bigint"))).first()
        if (m or 0) > WORTH * n:
            break
        placed.write.parquet(f"{folder}/cells={level}")
        inner = ends.where("cu = cv").select(F.col("cu").alias("cell"), "u", "v", "w", "hops", "last")
        inner.write.parquet(f"{folder}/inner={level}")

        def cliques(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            out, borders = adjacency(edges), set(nodes["node"])
            rows = [(b, v, d, h, p) for b in borders for v, (d, h, p) in settle(out, [(0, 0, b, b)], borders).items() if v != b and v in borders]
            return pd.DataFrame(rows, columns=["u", "v", "w", "hops", "last"])

        inside = spark.read.parquet(f"{folder}/inner={level}").groupBy("cell").cogroup(
            spark.read.parquet(f"{folder}/cells={level}").where("border").groupBy("cell")).applyInPandas(cliques, f"u {kind}, v {kind}, w bigint, hops bigint, last {kind}")
        graph = kept(between.unionByName(inside))
        level += 1
    graph.write.parquet(f"{folder}/top")
    return Overlay(spark, folder, level, n_edges <= TOP_EDGES)


# ------------------------------------------------------------------- searching
def _inside(labels: DataFrame, edges: DataFrame, kind: str, wanted: DataFrame | None = None) -> DataFrame:
    """Settle every (source, cell) of the labels (src, cell, node, d, hops, pred) inside its cell.

    A cell's sources are dealt to tasks in groups; each gets its own copy of the cell's edges.
    ``wanted`` (cell, node) limits the rows that come back, and stops a search that has them all.
    """
    counts = labels.groupBy("cell").agg((F.approx_count_distinct("src") / SOURCES).cast("bigint").alias("parts"))
    dealt = labels.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts") + 1)).drop("parts")
    groups = dealt.select(F.col("cell").alias("_c"), F.col("part").alias("_p")).distinct()
    rows = edges.join(groups, F.col("cell") == F.col("_c")).select(F.col("_c").alias("cell"), F.col("_p").alias("part"), "u", "v", "w", "hops", "last")
    if wanted is not None:
        # a row without target names a wanted node
        asked = wanted.join(groups, F.col("cell") == F.col("_c")).select(F.col("_c").alias("cell"), F.col("_p").alias("part"), F.col("node").alias("u"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("v", "w", "hops", "last")])
        rows = rows.unionByName(asked)
    limited = wanted is not None

    def run(labels: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        asked = edges["w"].isna()
        names = set(edges.loc[asked, "u"]) if limited else None
        real = edges[~asked].astype({"w": "int64", "hops": "int64"})
        if pd.api.types.is_numeric_dtype(real["u"]):
            real = real.astype({"v": "int64", "last": "int64"})
        out, found = adjacency(real), []
        for src, own in labels.groupby("src", sort=True):
            preds = [None if pd.isna(p) else p for p in own["pred"]]
            starts = zip(own["d"].tolist(), own["hops"].tolist(), own["node"].tolist(), preds, strict=True)
            for node, (d, h, pred) in settle(out, starts, names).items():
                if names is None or node in names:
                    found.append((src, node, d, h, pred))
        done = pd.DataFrame(found, columns=["src", "node", "d", "hops", "pred"])
        return done.astype({"pred": "Int64"}) if pd.api.types.is_numeric_dtype(real["u"]) else done

    return dealt.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInPandas(run, f"src {kind}, node {kind}, d bigint, hops bigint, pred {kind}")


def _packed(x: np.ndarray) -> bytes:
    """A column of numbers, byte by byte of all of them: equal high and low bytes lie together."""
    flat = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()
    return len(flat).to_bytes(8, "little") + (pa.compress(flat, codec="zstd", asbytes=True) if flat else b"")


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


_SHARD = "block bigint, shard bigint, rank int, n bigint, m bigint, d binary, h binary, open binary, eu binary, es binary, ev binary, ew binary, eh binary, s binary, v binary, low bigint"
_SHARD_NAMES = [c.split()[0] for c in _SHARD.split(", ")]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "shard": pa.int64(), "rank": pa.int32(), "n": pa.int64(), "m": pa.int64(), "low": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.binary())) for c in _SHARD_NAMES], names=_SHARD_NAMES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (block, shard) after another; the input is sorted by it."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and (row["block"], row["shard"]) != (held[0]["block"], held[0]["shard"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _take(state: dict, told: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, hops and open marks (sources x nodes, flat) after the told rows."""
    n, m = state["n"], state["m"]
    if state["d"] is None:
        d, h, open_ = np.full(n * m, FAR), np.zeros(n * m, np.int32), np.zeros(n * m, bool)
    else:
        d, h, open_ = (_unpacked(state[c], k).copy() for c, k in (("d", np.int64), ("h", np.int32), ("open", bool)))
    for r in told:
        at = _unpacked(r["s"], np.int32).astype(np.int64) * n + _unpacked(r["v"], np.int32)
        nd, nh = _unpacked(r["d"], np.int64), _unpacked(r["h"], np.int32)
        gain = (nd < d[at]) | ((nd == d[at]) & (nh < h[at]))
        # a row names a node once per source
        at = at[gain]
        d[at], h[at], open_[at] = nd[gain], nh[gain], True
    return d, h, open_


def _shards(labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Nodes numbered within shards, sources within blocks, the edges of every shard as one
    row, the labels by number."""
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).unionByName(labels.select("node")).distinct()
    ends = kept(ends)
    shards = 1 + ends.count() // SHARD
    shard = F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard")
    nodes = kept(ends.select("node", shard).withColumn("i", F.row_number().over(Window.partitionBy("shard").orderBy("node")) - 1))
    firsts = labels.select("src").distinct()
    blocks = 1 + firsts.count() // SOURCES
    sources = kept(firsts.withColumn("block", F.pmod(F.xxhash64("src"), F.lit(blocks))).withColumn("s", F.row_number().over(Window.partitionBy("block").orderBy("src")) - 1))
    at = lambda c, i, s: nodes.select(F.col("node").alias(c), F.col("i").alias(i), F.col("shard").alias(s)).hint("merge")
    numbered = edges.join(at("u", "ui", "us"), "u").join(at("v", "vi", "vs"), "v").select(
        F.col("us").alias("shard"), F.col("ui").alias("i"), F.col("vs").alias("to"), F.col("vi").alias("j"), "w", F.col("hops").cast("int").alias("hops"), "last")
    told = labels.join(sources, "src").join(at("node", "v", "shard"), "node").select("block", "shard", "s", "v", "d", F.col("hops").cast("int").alias("h"), "pred")
    return nodes, sources, kept(numbered), kept(told), int(shards * blocks)


def _relaxed(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Rounds of relaxation from the labels, for graphs with few hops.

    Nodes are cut into shards by hash; a shard's edges and the lengths of its nodes from a
    block of sources are packed columns of one row.  A round shuffles these rows and what
    the last one told: entries that are open and nearer than the round's limit tell their
    neighbours, one row per pair of shards.  The limit lies some mean edges above the nearest open
    entry, so few entries tell twice and rounds are hardly more than hops.  In the end each edge
    tells once more, for predecessors.
    """
    kind = edges.schema["u"].dataType.simpleString()
    nodes, sources, numbered, told, parts = _shards(labels, edges)

    def pack_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["to", "j"], kind="stable")
        cols = [_packed(pdf[c].to_numpy(k)) for c, k in (("i", np.int32), ("to", np.int32), ("j", np.int32), ("w", np.int64), ("hops", np.int32))]
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), *cols)], columns=["shard", "eu", "es", "ev", "ew", "eh"])

    def pack_labels(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["d", "h"], kind="stable").drop_duplicates(["s", "v"])
        cols = [_packed(best[c].to_numpy(k)) for c, k in (("d", np.int64), ("h", np.int32), ("s", np.int32), ("v", np.int32))]
        return pd.DataFrame([(int(pdf["block"].iloc[0]), int(pdf["shard"].iloc[0]), *cols, int(best["d"].min()))], columns=["block", "shard", "d", "h", "s", "v", "low"])

    none = {c: F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _SHARD.split(", "))}
    full = lambda df: df.select(*[df[c].cast(dict(x.split() for x in _SHARD.split(", "))[c]).alias(c) if c in df.columns else none[c] for c in _SHARD_NAMES])
    packed = numbered.drop("last").groupBy("shard").applyInPandas(pack_edges, "shard bigint, eu binary, es binary, ev binary, ew binary, eh binary")
    sizes = nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).join(packed, "shard", "left")
    state = sizes.crossJoin(sources.groupBy("block").agg(F.count(F.lit(1)).alias("m"))).withColumn("rank", F.lit(0))
    first = told.drop("pred").groupBy("block", "shard").applyInPandas(pack_labels, "block bigint, shard bigint, d binary, h binary, s binary, v binary, low bigint").withColumn("rank", F.lit(1))
    state = kept(full(state).unionByName(full(first)))
    step = int(AHEAD * (edges.agg(F.avg("w")).first()[0] or 0)) + 1

    def round_(limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for state, *rows in _groups(batches):
                d, h, open_ = _take(state, rows)
                n = state["n"]
                now = np.flatnonzero(open_ & (d < limit))
                if len(now) and state["eu"] is not None:
                    yield from tell(state, d, h, now, n)
                open_[now] = False
                low = d[open_].min() if open_.any() else None
                yield _rows([state | {"d": _packed(d), "h": _packed(h), "open": _packed(open_), "low": None if low is None else int(low)}])

        def tell(state: dict, d: np.ndarray, h: np.ndarray, now: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
            eu, es, ev = (_unpacked(state[c], np.int32) for c in ("eu", "es", "ev"))
            ew, eh = _unpacked(state["ew"], np.int64), _unpacked(state["eh"], np.int32)
            by_node = np.argsort(eu, kind="stable")
            bounds = np.searchsorted(eu[by_node], np.arange(n + 1))
            counts = np.diff(bounds)[now % n]
            entry = np.repeat(now, counts)
            if not len(entry):
                return
            offset = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
            edge = by_node[bounds[entry % n] + offset]
            src, nd, nh = (entry // n).astype(np.int32), d[entry] + ew[edge], h[entry] + eh[edge]
            order = np.lexsort((nh, nd, ev[edge], src, es[edge]))
            src, nd, nh, to, v = src[order], nd[order], nh[order], es[edge][order], ev[edge][order]
            lead = np.ones(len(src), bool)
            lead[1:] = (src[1:] != src[:-1]) | (to[1:] != to[:-1]) | (v[1:] != v[:-1])
            src, nd, nh, to, v = src[lead], nd[lead], nh[lead], to[lead], v[lead]
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            for a, z in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
                yield _rows([{"block": state["block"], "shard": int(to[a]), "rank": 1, "d": _packed(nd[a:z]), "h": _packed(nh[a:z]), "s": _packed(src[a:z]), "v": _packed(v[a:z]), "low": int(nd[a:z].min())}])

        return run

    while (low := state.agg(F.min("low")).first()[0]) is not None:
        state = kept(state.repartition(parts, "block", "shard").sortWithinPartitions("block", "shard", "rank").mapInArrow(round_(low + step), _SHARD))
    return _predecessors(state, nodes, sources, numbered, told, kind, parts)


def _predecessors(state: DataFrame, nodes: DataFrame, sources: DataFrame, numbered: DataFrame, told: DataFrame, kind: str, parts: int) -> DataFrame:
    """(src, node, d, hops, pred, near) of finished shards: the smallest ``last`` of the edges that close a
    gap with the fewest hops, and of those that close it from a nearer node."""
    names = nodes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("i", "node")))["node"].alias("nodes"))
    firsts = sources.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("s", "src")))["src"].alias("srcs"))
    # the edges again, with their last nodes, in the order they are told
    lasts = numbered.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("to", "j", "i", "w", "hops", "last"))).alias("e")).select(
        "shard", *[F.col(f"e.{c}").alias(c) for c in ("to", "j", "i", "w", "hops", "last")])
    schema = f"block bigint, shard bigint, rank int, n bigint, d binary, h binary, s binary, v binary, w binary, last array<{kind}>, nodes array<{kind}>, srcs array<{kind}>"
    columns = [c.split()[0] for c in schema.split(", ")]
    fields = {"block": pa.int64(), "shard": pa.int64(), "rank": pa.int32(), "n": pa.int64()}

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = b.schema.field("last").type
            for r in range(b.num_rows):
                row = {c: b[c][r].as_py() for c in ("block", "n", "d", "h")}
                d, h = (_unpacked(row[c], k).reshape(-1, row["n"]) for c, k in (("d", np.int64), ("h", np.int32)))
                to, j, i, w, hops = (np.asarray(b[c][r].values) for c in ("to", "j", "i", "w", "hops"))
                kinds = fields | {"last": like, "nodes": like, "srcs": like}
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                for a, z in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
                    near = d[:, i[a:z]]
                    near = np.where(near == FAR, FAR, near + w[a:z])
                    out = {"block": row["block"], "shard": int(to[a]), "rank": 2, "d": _packed(near.reshape(-1)), "v": _packed(j[a:z].astype(np.int32)),
                           "w": _packed(w[a:z].astype(np.int64)), "h": _packed((h[:, i[a:z]] + hops[a:z]).astype(np.int32).reshape(-1)), "last": b["last"][r].values[a:z].to_pylist()}
                    yield pa.RecordBatch.from_arrays([pa.array([out.get(c)], kinds.get(c, pa.binary())) for c in columns], names=columns)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state, *rows in _groups(batches):
            n, d, h = state["n"], _unpacked(state["d"], np.int64), _unpacked(state["h"], np.int32)
            known, back = np.unique(np.array([x for r in rows for x in r["last"] if x is not None] or state["nodes"][:1]), return_inverse=True)
            pred, near, done = np.full(len(d), len(known)), np.full(len(d), len(known)), 0
            given = np.full(len(d), -2)
            for r in rows:
                v, nd, nh = _unpacked(r["v"], np.int32).astype(np.int64), _unpacked(r["d"], np.int64), _unpacked(r["h"], np.int32)
                real = np.array([x is not None for x in r["last"]], bool)
                codes = np.full(len(real), -1)
                codes[real] = back[done:done + real.sum()]
                done += int(real.sum())
                if r["rank"] == 1:
                    at = _unpacked(r["s"], np.int32).astype(np.int64) * n + v
                    met = (d[at] == nd) & (h[at] == nh)
                    given[at[met]] = codes[met]
                    continue
                w = _unpacked(r["w"], np.int64)
                for s in range(len(d) // n):
                    own = slice(s * len(v), (s + 1) * len(v))
                    dv, dn = d[s * n + v], nd[own]
                    met = np.flatnonzero((np.abs(dn - dv) < OFF) & (dn != FAR))
                    at, exact, nearer = s * n + v[met], (dn[met] == dv[met]) & (nh[own][met] == h[s * n + v[met]]), dn[met] - w[met] < dv[met]
                    np.minimum.at(pred, at[exact], codes[met[exact]])
                    np.minimum.at(near, at[nearer], codes[met[nearer]])
            pred = np.where(given > -2, given, pred)
            found, names, srcs = np.flatnonzero(d != FAR), np.array(state["nodes"]), np.array(state["srcs"])
            kind_of = pa.array(names[:1]).type
            for a in range(0, len(found), 1 << 16):
                at = found[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(srcs[at // n]), pa.array(names[at % n]), pa.array(d[at]), pa.array(h[at].astype(np.int64)),
                    pa.array(known[np.maximum(pred[at], 0)], mask=pred[at] < 0, type=kind_of), pa.array(known[near[at] % len(known)], mask=near[at] == len(known), type=kind_of)],
                    names=["src", "node", "d", "hops", "pred", "near"])

    none = lambda c: F.lit(None).cast(dict(x.split(" ", 1) for x in schema.split(", "))[c]).alias(c)
    plain = state.select("block", "shard", "n", "d", "h")
    told_again = plain.join(lasts.hint("merge"), "shard").mapInArrow(tell, schema)
    given = told.groupBy("block", "shard").applyInPandas(lambda pdf: pd.DataFrame([(
        int(pdf["block"].iloc[0]), int(pdf["shard"].iloc[0]), *[_packed(pdf[c].to_numpy(k)) for c, k in (("d", np.int64), ("h", np.int32), ("s", np.int32), ("v", np.int32))],
        [None if pd.isna(x) else x for x in pdf["pred"]])], columns=["block", "shard", "d", "h", "s", "v", "last"]), f"block bigint, shard bigint, d binary, h binary, s binary, v binary, last array<{kind}>")
    given = given.select("block", "shard", F.lit(1).alias("rank"), none("n"), "d", "h", "s", "v", none("w"), "last", none("nodes"), none("srcs"))
    whole = plain.join(names, "shard").join(firsts, "block").select("block", "shard", F.lit(0).alias("rank"), "n", "d", "h", none("s"), none("v"), none("w"), none("last"), "nodes", "srcs")
    rows = whole.unionByName(given).unionByName(told_again)
    return rows.repartition(parts, "block", "shard").sortWithinPartitions("block", "shard", "rank").mapInArrow(close, f"src {kind}, node {kind}, d bigint, hops bigint, pred {kind}, near {kind}")


def search(overlay: Overlay, sources: DataFrame, targets: DataFrame | None = None, near: bool = False) -> DataFrame:
    """Shortest directed paths: src, node, dist_m and pred, the node before it (null at the
    source itself), for every node that a source (src) reaches, or for the targets (node_id) only.
    With ``near`` also the smallest node that a shortest path can come from (to 1e-6 m; null
    where no nearer one leads), in a graph that is searched by rounds only.

    A source without edges reaches itself.  Jobs run while the result is built.
    """
    top = overlay.top()
    kind = top.schema["u"].dataType.simpleString()
    blank = F.lit(None).cast(kind)
    first = sources.where("src is not null").select(F.col("src").cast(kind).alias("src")).distinct().select(
        "src", F.col("src").alias("node"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("hops"), blank.alias("pred"))
    climbed = [kept(first)]
    for level in range(overlay.levels):
        cells = overlay.cells(level)
        here = climbed[-1].join(cells.select("node", "cell"), "node")
        border = cells.where("border").select("cell", "node")
        climbed.append(kept(_inside(here, overlay.inner(level), kind, border)))
    if overlay.small:
        one = F.lit(0).alias("cell")
        found = _inside(climbed[-1].select("*", one), top.select("*", one), kind, None if targets is None or overlay.levels else targets.select(one, F.col("node_id").cast(kind).alias("node")).distinct())
    else:
        found = _relaxed(climbed[-1], top)
    needed = None
    if targets is not None and overlay.levels:
        # cells that hold targets, then those that hold borders of such cells
        needed, nodes = [], targets.select(F.col("node_id").cast(kind).alias("node")).distinct()
        for level in range(overlay.levels):
            cells = overlay.cells(level)
            needed.append(kept(nodes.join(cells.select("node", "cell"), "node").select("cell").distinct()))
            nodes = cells.where("border").join(needed[-1], "cell").select("node")
    for level in reversed(range(overlay.levels)):
        cells = overlay.cells(level).select("node", "cell")
        entered = kept(found.drop("near")).unionByName(climbed[level]).join(cells, "node")
        if needed is not None:
            entered = entered.join(needed[level], "cell", "left_semi")
        found = _inside(entered, overlay.inner(level), kind)
    extra = ["near"] if near and "near" in found.columns else []
    found = kept(found.select("src", "node", (F.col("d") / UNIT).alias("dist_m"), "pred", *extra))
    own = found.where("src = node").select("src")
    alone = first.select("src", "node", F.lit(0.0).alias("dist_m"), "pred", *[blank.alias(c) for c in extra]).join(own, "src", "left_anti")
    if targets is None:
        return found.unionByName(alone)
    return kept(found.unionByName(alone).join(
        targets.select(F.col("node_id").cast(kind).alias("node")).distinct(), "node", "left_semi").select("src", "node", "dist_m", "pred", *extra))
