"""Scoring texts with a hierarchical Pitman-Yor language model.

Three levels of restaurants.  Every previous word has a restaurant of its own (context 0 is
the start of a text), so their number grows with the corpus.  Its parent is the restaurant of
the word's class: the word itself if it has at most four bytes, else its last two bytes,
hashed to ``CONTEXTS`` classes.  The parent of all classes is the root.  In restaurant u, dish
w has c customers at t tables, and sends t customers to the parent v of u; the root's base
measure is diffuse over unseen words, so every dish has one table there:

    P(w)     = (m_w - d0) / (s0 + M),  m_w = sum over classes of t_vw, M = sum of all m
    P(unseen)= (s0 + d0 * V) / (s0 + M)
    P(w | u) = (c_uw - d * t_uw + (s + d * t_u) * P(w | v)) / (s + c_u)

Seating is sampled by Gibbs sweeps: the tables of every (u, w) are redrawn given all others,
from their conditional, S(c, t) * prod_{i<t} (s + d * (others + i)) * P(w | v)^t with generalised
Stirling numbers S: from their recursion for up to ``EXACT`` customers, as an integral above.
P(w | v) is held fixed while a pair's tables are drawn.  Sweeps update all words at once from
the totals of the sweep before.  The predictive probabilities of the last ``SAMPLES`` seatings
are averaged; each sums to one in every restaurant.

Work: texts are read once and become blocks: the distinct (word, context) pairs of about
``BLOCK`` tokens, cut into parts by word hash, and per text the numbers of its pairs.  A
part of the vocabulary with the pairs of all blocks is one unit of the sweeps; only sums per
restaurant are shared: those of the classes through the driver, those of the previous words
by a shuffle, each part sending what it holds to the shards of the contexts' ids and getting
the whole corpus' sums back.  Answers go back block by block.  Words are told apart by 64-bit
hashes, contexts by 58 bits of them with the class in the lowest six.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import delete_path, fold_of
from tripwise.llm.hashing import mixed, pieces, word_hashes
from tripwise.session import scratch_path

#: Parameters: classes of contexts, sweeps before and after the first sample, strengths, tokens per
#: block, documents per part of the vocabulary.
CONTEXTS = 64
BURN_IN = 1
SAMPLES = 3
STRENGTH = 1.0
BLOCK = 1 << 22
PART_DOCS = 4000
#: Customers up to which Stirling numbers come from their recursion; numbers of tables weighed on each side of
#: the likeliest one above that, and numbers worked on at once.
EXACT = 1024
AROUND = 32
WORK = 1 << 18
#: Hash of the end of a text.
END = np.uint64(0x5BD1E995)


def _pack(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + (pa.compress(a.tobytes(), codec="zstd", asbytes=True) if len(a) else b"")


def _unpack(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=n * np.dtype(kind).itemsize, codec="zstd"), kind)


def text_tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, token hashes, context ids) of every text, the end included."""
    for first, data, offsets in pieces(texts):
        hashes, bounds, at, to, low = word_hashes(data, offsets)
        size = to - at
        tail = low[np.maximum(to - 2, 0)].astype(np.uint64) * np.uint64(256) + low[to - 1] if len(to) else hashes
        kind = np.where(size <= 4, hashes, mixed(tail + np.uint64(1)))
        kind = kind % np.uint64(CONTEXTS - 1) + np.uint64(1)
        kind = ((hashes & ~np.uint64(CONTEXTS - 1)) | kind).view(np.int64)
        for r in range(len(offsets) - 1):
            a, b = bounds[r], bounds[r + 1]
            yield first + r, np.append(hashes[a:b], END), np.concatenate([np.zeros(1, np.int64), kind[a:b]])


_BLOCKS = "kind string, block bigint, part bigint, words binary, sizes binary, cids binary, ctx binary, train binary, doc_id bigint, held_out boolean, codes binary"


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "block": pa.int64(), "part": pa.int64(), "shard": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "rank": pa.int32(),
             "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "sums": pa.list_(pa.float64()), "seats": pa.list_(pa.binary())}
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, cols, strict=True)], names=names)


def encode_blocks(docs: DataFrame, parts: int, held: int, folds: int) -> DataFrame:
    """Rows of kind "pair" (a block's words of one part with contexts and training counts)
    and of kind "text" (a text as numbers of its block's pairs)."""
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        open_: list[tuple] = []
        size = 0
        for b in batches:
            ids, out = b["doc_id"].to_pylist(), b["held_out"].to_pylist()
            for r, tokens, ctx in text_tokens(b["text"]):
                open_.append((ids[r], out[r], tokens, ctx))
                size += len(tokens)
                if size >= BLOCK:
                    yield from flush(open_, (task << 24) + number)
                    open_, size, number = [], 0, number + 1
        if open_:
            yield from flush(open_, (task << 24) + number)

    def flush(open_: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
        lengths = [len(o[2]) for o in open_]
        texts = [o[:2] for o in open_]
        tokens = np.concatenate([o[2] for o in open_])
        ctx = np.concatenate([o[3] for o in open_])
        open_.clear()  # a block is large: nothing is kept longer than it is needed
        words, back = np.unique(tokens, return_inverse=True)
        del tokens
        # words by part, so a part's pairs are consecutive
        order = np.argsort(mixed(words) % np.uint64(parts), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words = words[order]
        numbers = place[back]
        del back
        contexts, ctx = np.unique(ctx, return_inverse=True)
        numbers *= len(contexts)
        numbers += ctx
        pairs, codes = np.unique(numbers, return_inverse=True)
        del numbers, ctx
        codes = codes.astype(np.int32)
        learned = np.repeat([not held_out for _, held_out in texts], lengths)
        train = np.bincount(codes[learned], minlength=len(pairs))
        word = pairs // len(contexts)
        sizes = np.bincount(word, minlength=len(words))
        part = (mixed(words) % np.uint64(parts)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        stops = np.append(cuts[1:], len(words))
        rows = []
        for a, z in zip(cuts, stops, strict=True):
            p = slice(edges[a], edges[z])
            held_ctx, own = np.unique(pairs[p] % len(contexts), return_inverse=True)
            rows.append(("pair", block, int(part[a]), words[a:z].tobytes(), _pack(sizes[a:z].astype(np.int32)), contexts[held_ctx].tobytes(),
                         _pack(own.astype(np.int32)), _pack(train[p].astype(np.int32)), None, None, None))
        yield _rows(names, rows)
        at, rows = 0, []
        for (doc_id, held_out), size in zip(texts, lengths, strict=True):
            rows.append(("text", block, None, None, None, None, None, None, doc_id, held_out, _pack(codes[at:at + size])))
            at += size
        yield _rows(names, rows)

    told = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")
    return told.mapInArrow(encode, _BLOCKS)


@dataclass(frozen=True)
class Totals:
    """Sums over the whole model for one level: tokens and tables per restaurant, types, and
    the discounts of the level and of the root."""

    customers: np.ndarray
    tables: np.ndarray
    types: float
    d: float
    d0: float

    @property
    def root(self) -> float:
        return float(self.tables.sum())


@dataclass(frozen=True)
class Model:
    """Sums of the classes, discount of the previous words' restaurants, training tokens."""

    classes: Totals
    d: float
    tokens: float


def _classes(wi: np.ndarray, ctx: np.ndarray, cids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, word) of every pair of a word and a class, and each pair's number among them."""
    pairs, back = np.unique(wi * CONTEXTS + (cids & (CONTEXTS - 1))[ctx], return_inverse=True)
    return pairs % CONTEXTS, pairs // CONTEXTS, back


def _sums(c: np.ndarray, kc: np.ndarray, kt: np.ndarray, kind: np.ndarray, kwi: np.ndarray, n: int) -> list[float]:
    m = np.bincount(kwi, kt, n)
    rest = [float(x) for x in ((m > 0).sum(), c.sum(), *((x == i).sum() for x in (c, kc, m) for i in (1, 2)))]
    return np.bincount(kind, kc, CONTEXTS).tolist() + np.bincount(kind, kt, CONTEXTS).tolist() + rest


def _totals(state: DataFrame) -> Model:
    got = {r["i"]: r["s"] for r in state.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect()}
    v = np.array([got.get(i, 0.0) for i in range(2 * CONTEXTS + 8)])
    types, tokens, c1, c2, k1, k2, m1, m2 = v[2 * CONTEXTS:]
    discount = lambda one, two: float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5
    return Model(Totals(v[:CONTEXTS], v[CONTEXTS:2 * CONTEXTS], float(types), discount(k1, k2), discount(m1, m2)), discount(c1, c2), float(tokens))


def log_stirling(d: float, most: int) -> np.ndarray:
    """log of generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = out[c, 1:c + 1] + np.log(np.maximum(c - d * t, 0))
        out[c + 1, 1:c + 1] = stay
        out[c + 1, 2:c + 2] = np.logaddexp(out[c + 1, 2:c + 2], out[c, 1:c + 1])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, from Stirling's series at x + 8."""
    y = x + 8.0
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _log_sizes(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of S(c, t) * d^t * t! / c! for many customers.

    That is the coefficient of z^c in (1 - (1 - z)^d)^t: with z = exp(-p), the integral of
    exp(f(p)), f(p) = t * log(1 - (1 - z)^d) + c * p, over a path around the negative p.  The
    path goes through the point where f' is zero, or 3 / c if that is more, and bends to the
    left; where nearly every customer has a table of its own it is the circle of z.
    """
    c, t = np.broadcast_arrays(np.asarray(c, np.float64), np.asarray(t, np.float64))
    shape, c, t = c.shape, c.ravel(), t.ravel()

    def slope(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = -np.expm1(-p)
        power = d * np.log(y)
        with np.errstate(divide="ignore"):
            return d * np.exp(power - p) / (y * -np.expm1(power)), y

    low, high = np.full(c.shape, -700.0), np.full(c.shape, 4.0)
    for _ in range(40):
        middle = (low + high) / 2
        right = slope(np.exp(middle))[0] * t > c
        low, high = np.where(right, middle, low), np.where(right, high, middle)
    p = np.maximum(np.exp((low + high) / 2), 3 / c)
    g, y = slope(p)
    width = 1 / np.sqrt(np.maximum(t * g * ((1 - d) * np.exp(-p) / y + 1 - g), 1e-12))
    round_ = (width > 0.1) & (p > 0.3)
    width = np.minimum(width, p)
    few = ~round_ & (t * y**d < 0.5)
    out = c * np.log(d)
    for kind in (0, 1, 2):
        at = np.flatnonzero((t < c) & (round_ if kind == 2 else few if kind == 1 else ~round_ & ~few))
        if not len(at):
            continue
        cc, tt, v, w = c[at], t[at], p[at], width[at]
        top = cc * v if kind == 1 else cc * v + tt * np.log(-np.expm1(d * np.log(-np.expm1(-v))))
        total = np.zeros(len(at))
        for k in range(65 if kind == 2 else 32):
            if kind == 2:
                path, step = v + 1j * np.pi * k / 64, 1j * (np.pi / 64) * (0.5 if k in (0, 64) else 1)
            else:
                path = v + w * (1j * np.sinh(0.14 * k) - 0.5 * (np.cosh(0.14 * k) - 1))
                step = w * (1j * np.cosh(0.14 * k) - 0.5 * np.sinh(0.14 * k)) * (0.07 if k == 0 else 0.14)
            inside = np.abs(path.imag) <= np.pi
            path = np.where(inside, path, v)
            power = tt * np.log1p(-((-np.expm1(-path)) ** d))
            # a first factor near one is taken less one, whose integral is nothing
            value = np.expm1(power) * np.exp(cc * path - top) if kind == 1 else np.exp(power + cc * path - top)
            total += np.where(inside, (value * step).imag, 0)
        out[at] = top + np.log(np.maximum(total, 1e-300) / np.pi)
    return out.reshape(shape)


def _redraw_many(c: np.ndarray, t: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of pairs with many customers: a draw from weights around the likeliest number,
    level over steps of a fraction of the deviation, and a Metropolis step from the present number."""
    c, t, others, parent = c[:, None], np.clip(t, 1, c)[:, None], others[:, None], parent[:, None]
    base = STRENGTH / d + others

    def weight(x: np.ndarray) -> np.ndarray:
        return _log_sizes(d, c, x) - _log_gamma(x + 1.0) + _log_gamma(base + x) - _log_gamma(base) + x * np.log(parent)

    low, high = np.ones_like(c), c.copy()
    while (low < high).any():
        middle = (low + high) // 2
        up = (low < high) & (weight(np.minimum(middle + 1, c)) > weight(middle))
        low, high = np.where(up, middle + 1, low), np.where(up, high, middle)
    best, top, step = low, weight(low), np.ones_like(c)
    while True:
        ends = [best - AROUND * step, best + AROUND * step]
        short = ((ends[0] > 1) & (weight(np.maximum(ends[0], 1)) > top - 30)) | ((ends[1] < c) & (weight(np.minimum(ends[1], c)) > top - 30))
        if not short.any():
            break
        step = np.where(short, 2 * step, step)
    nodes = best + step * np.arange(-AROUND, AROUND + 1)
    inside = (nodes >= 1) & (nodes <= c)
    logs = np.where(inside, weight(np.clip(nodes, 1, c)), -np.inf)
    sums = np.cumsum(np.exp(logs - top), axis=1)
    pick = (draw.random(c.shape) * sums[:, -1:] > sums).sum(axis=1, keepdims=True)
    fresh = np.take_along_axis(nodes, pick, 1) + np.floor(draw.random(c.shape) * step).astype(np.int64) - step // 2
    allowed = (fresh >= 1) & (fresh <= c)
    now = (t - best + step // 2) // step + AROUND
    level = np.where((now >= 0) & (now <= 2 * AROUND), np.take_along_axis(logs, np.clip(now, 0, 2 * AROUND), 1), -np.inf)
    # a present number that no draw reaches is left for good
    kept = np.where(np.isfinite(level), weight(t) - level, -np.inf)
    ratio = weight(np.clip(fresh, 1, c)) - np.take_along_axis(logs, pick, 1) - kept
    return np.where(allowed & (np.log(draw.random(c.shape)) < ratio), fresh, t)[:, 0]


def resample(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, wi: np.ndarray, n: int, total: Totals, draw: np.random.Generator) -> np.ndarray:
    """New tables of every pair of a restaurant under the root, given those of all others."""
    if not total.root:
        return np.minimum(c, 1).astype(np.int64)
    m = np.bincount(wi, t, n)
    return redraw(c, t, ctx, (np.maximum(m[wi] - t, 1) - total.d0) / (STRENGTH + total.root), total, draw)


def redraw(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, parent: np.ndarray, total: Totals, draw: np.random.Generator) -> np.ndarray:
    """New tables of every pair whose dish has probability ``parent`` in the parent restaurant."""
    out = np.minimum(c, 1).astype(np.int64)
    others = total.tables[ctx] - t
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    sizes, starts = np.unique(c[few], return_index=True)
    stirling = log_stirling(total.d, int(sizes[-1]) if len(sizes) else 1)
    for size, a, z in zip(sizes, starts, np.append(starts, len(few))[1:], strict=True):
        tables = np.arange(1, size + 1)
        for i in range(a, z, max(1, WORK // int(size))):
            at = few[i:min(z, i + max(1, WORK // int(size)))]
            gain = np.log(STRENGTH + total.d * (others[at, None] + tables[None, :] - 1)) + np.log(parent[at])[:, None]
            weight = stirling[size, 1:size + 1][None, :] + np.cumsum(gain, axis=1)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            weight = np.cumsum(weight, axis=1)
            out[at] = 1 + (draw.random(len(at))[:, None] * weight[:, -1:] > weight).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    for i in range(0, len(many), WORK // (2 * AROUND)):
        at = many[i:i + WORK // (2 * AROUND)]
        out[at] = _redraw_many(c[at], t[at], others[at].astype(np.float64), parent[at], total.d, draw)
    return out


def seated(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, parent: np.ndarray, total: Totals) -> np.ndarray:
    """P(w | u) of every pair from that of the parent restaurant."""
    own = np.maximum(c - total.d * t, 0)
    return (own + (STRENGTH + total.d * total.tables[ctx]) * parent) / (STRENGTH + total.customers[ctx])


def predictive(c: np.ndarray, t: np.ndarray, ctx: np.ndarray, wi: np.ndarray, n: int, total: Totals) -> np.ndarray:
    """P(w | u) of every pair under the root; a word without training tokens is the unseen word."""
    m = np.bincount(wi, t, n)
    root = STRENGTH + total.root
    parent = np.where(m > 0, (m - total.d0) / root, (STRENGTH + total.d0 * total.types) / root)[wi]
    return seated(c, t, ctx, parent, total)


def _without(t: np.ndarray, kc: np.ndarray, kt: np.ndarray, kind: np.ndarray, kwi: np.ndarray, back: np.ndarray, n: int, total: Totals) -> np.ndarray:
    """P(w | class) for every pair, without the customers that the pair itself sent there."""
    customers = kc[back] - t
    tables = np.minimum(kt[back], customers)
    m = np.bincount(kwi, kt, n)[kwi[back]] - (kt[back] - tables)
    base = (np.maximum(m, 1) - total.d0) / (STRENGTH + total.root)
    own = np.maximum(customers - total.d * tables, 0)
    return (own + (STRENGTH + total.d * total.tables[kind[back]]) * base) / (STRENGTH + total.customers[kind[back]] - t)


_STATE = "part bigint, words binary, sizes binary, cids binary, ctx binary, c binary, t binary, kt binary, seats array<binary>, sums array<double>"
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _by_part(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one key after another; the input is sorted by it."""
    current, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if row[key] != current and held:
                yield current, held
                held = []
            current = row[key]
            held.append(row)
    if held:
        yield current, held


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state row per part: all blocks' pairs summed, one table per seated dish."""
    for part, rows in _by_part(batches, "part"):
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        spread = [np.repeat(w, _unpack(r["sizes"], np.int32)) for w, r in zip(words, rows, strict=True)]
        all_words, back = np.unique(np.concatenate(spread), return_inverse=True)
        del spread
        held = [np.frombuffer(r["cids"], np.int64) for r in rows]
        cids = np.unique(np.concatenate(held))
        ctx = np.concatenate([np.searchsorted(cids, h)[_unpack(r["ctx"], np.int32)] for h, r in zip(held, rows, strict=True)])
        pairs, back = np.unique(back * len(cids) + ctx, return_inverse=True)
        c = np.bincount(back, np.concatenate([_unpack(r["train"], np.int32) for r in rows]), len(pairs)).astype(np.int64)
        wi, own = pairs // len(cids), pairs % len(cids)
        t = np.minimum(c, 1)
        kind, kwi, back = _classes(wi, own, cids)
        kc = np.bincount(back, t, len(kind)).astype(np.int64)
        kt = np.minimum(kc, 1)
        sizes = np.bincount(wi, minlength=len(all_words)).astype(np.int32)
        yield _rows(_STATE_NAMES, [(part, all_words.tobytes(), _pack(sizes), cids.tobytes(), _pack(own.astype(np.int32)), _pack(c), _pack(t), _pack(kt),
                                    [], _sums(c, kc, kt, kind, kwi, len(all_words)))])


def _restaurants(state: DataFrame, shards: int) -> DataFrame:
    """Rows (part, shard, cu, tu): tokens and tables that the whole corpus has in the
    restaurants of a part's contexts.  A shard is a range of context ids."""
    names, back = ["shard", "part", "cids", "cu", "tu"], ["part", "shard", "cu", "tu"]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cids, ctx = np.frombuffer(r["cids"], np.int64), _unpack(r["ctx"], np.int32)
                cu, tu = (np.bincount(ctx, _unpack(r[x], np.int64), len(cids)).astype(np.int64) for x in ("c", "t"))
                shard = (((cids >> 32) + (1 << 31)) * shards) >> 32
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                yield _rows(names, [(int(shard[a]), r["part"], cids[a:z].tobytes(), _pack(cu[a:z]), _pack(tu[a:z]))
                                    for a, z in zip(cuts, np.append(cuts[1:], len(cids)), strict=True)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_part(batches, "shard"):
            ids, at = np.unique(np.concatenate([np.frombuffer(r["cids"], np.int64) for r in rows]), return_inverse=True)
            cu, tu = (np.bincount(at, np.concatenate([_unpack(r[x], np.int64) for r in rows]), len(ids)).astype(np.int64) for x in ("cu", "tu"))
            done = 0
            for r in rows:
                own = at[done:done + len(r["cids"]) // 8]
                done += len(own)
                yield _rows(back, [(r["part"], shard, _pack(cu[own]), _pack(tu[own]))])

    told = state.select("part", "cids", "ctx", "c", "t").mapInArrow(shares, "shard bigint, part bigint, cids binary, cu binary, tu binary")
    return told.repartition("shard").sortWithinPartitions("shard").mapInArrow(whole, "part bigint, shard bigint, cu binary, tu binary")


def _sweep(state: DataFrame, model: Model, number: int, seed: int, shards: int) -> DataFrame:
    """Keep the seating as it is as a sample, with its own totals, then redraw it."""
    kept = ["words", "sizes", "cids", "ctx", "c", "t", "kt", "seats"]
    classes = model.classes

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, tables = [], []
        for b in batches:
            for r in b.to_pylist():
                if r["words"] is None:
                    customers.append(_unpack(r["cu"], np.int64))
                    tables.append(_unpack(r["tu"], np.int64))
                    continue
                total = Totals(np.concatenate(customers), np.concatenate(tables), classes.types, model.d, classes.d0)
                customers, tables = [], []
                words, sizes, cids, ctx = np.frombuffer(r["words"], np.uint64), _unpack(r["sizes"], np.int32), np.frombuffer(r["cids"], np.int64), _unpack(r["ctx"], np.int32)
                if len(total.tables) != len(cids):
                    raise ValueError("a part of the model came without all its restaurants")
                c, t, kt, seats = _unpack(r["c"], np.int64), _unpack(r["t"], np.int64), _unpack(r["kt"], np.int64), r["seats"]
                n = len(words)
                kind, kwi, back = _classes(np.repeat(np.arange(n), sizes), ctx, cids)
                kc = np.bincount(back, t, len(kind)).astype(np.int64)
                if number > BURN_IN:
                    seats = [*seats, r["t"], r["kt"], _pack(total.customers), _pack(total.tables)]
                if number < BURN_IN + SAMPLES and classes.root:
                    draw = np.random.default_rng([seed, number, r["part"]])
                    t = redraw(c, t, ctx, _without(t, kc, kt, kind, kwi, back, n, classes), total, draw)
                    kc = np.bincount(back, t, len(kind)).astype(np.int64)
                    kt = resample(kc, kt, kind, kwi, n, classes, draw)
                yield _rows(_STATE_NAMES, [(r["part"], r["words"], r["sizes"], r["cids"], r["ctx"], r["c"], _pack(t), _pack(kt), seats, _sums(c, kc, kt, kind, kwi, n))])

    none = F.lit(None).cast("binary")
    rows = state.select("part", F.lit(None).cast("bigint").alias("shard"), none.alias("cu"), none.alias("tu"), *kept)
    sums = _restaurants(state, shards).select("part", "shard", "cu", "tu", *(F.lit(None).cast(state.schema[k].dataType).alias(k) for k in kept))
    return sums.unionByName(rows).repartition("part").sortWithinPartitions("part", F.col("shard").asc_nulls_last()).mapInArrow(sweep, _STATE)


_ANSWER = ["block", "part", "rank", "known", "logs", "doc_id", "held_out", "codes"]
_ANSWER_SCHEMA = "block bigint, part bigint, rank int, known binary, logs binary, doc_id bigint, held_out boolean, codes binary"


def _averaged(r: dict, models: list[Model]) -> np.ndarray:
    """Mean of P(w | u) over the sampled seatings, for every pair of a part."""
    cids, ctx, c = np.frombuffer(r["cids"], np.int64), _unpack(r["ctx"], np.int32), _unpack(r["c"], np.int64)
    sizes = _unpack(r["sizes"], np.int32)
    kind, kwi, back = _classes(np.repeat(np.arange(len(sizes)), sizes), ctx, cids)
    out = np.zeros(len(c))
    for i, model in enumerate(models):
        t, kt, cu, tu = (_unpack(x, np.int64) for x in r["seats"][4 * i:4 * i + 4])
        kc = np.bincount(back, t, len(kind)).astype(np.int64)
        total = Totals(cu, tu, model.classes.types, model.d, model.classes.d0)
        out += seated(c, t, ctx, predictive(kc, kt, kind, kwi, len(sizes), model.classes)[back], total)
    return out / len(models)


def _answers(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    """Per block and part: training counts of its words' pairs and their log10 probabilities.
    The state of a part (rank 0) comes before its blocks."""
    part, words, cids, keys, counts, logs = None, None, None, None, None, None
    for b in batches:
        for r in b.to_pylist():
            own, sizes, held, ctx = np.frombuffer(r["words"], np.uint64), _unpack(r["sizes"], np.int32), np.frombuffer(r["cids"], np.int64), _unpack(r["ctx"], np.int32)
            wi = np.repeat(np.arange(len(own)), sizes)
            if r["rank"] == 0:
                part, words, cids, keys = r["part"], own, held, wi * len(held) + ctx
                counts = np.bincount(wi, _unpack(r["c"], np.int64), len(own)).astype(np.int64)
                logs = np.log10(_averaged(r, models)).astype(np.float32)
                continue
            if r["part"] != part:
                raise ValueError("a block came before its part of the model")
            at = np.searchsorted(words, own)
            found = np.searchsorted(keys, at[wi] * len(cids) + np.searchsorted(cids, held)[ctx])
            yield _rows(_ANSWER, [(r["block"], r["part"], 0, _pack(counts[at][wi]), _pack(logs[found]), None, None, None)])


def _scored(n: float, v: float):
    """Scores of texts; a block's answers (rank 0, by part) come before its texts."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, logs, base, closed = None, [], [], None, False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["block"] != block:
                    block, known, logs, closed = r["block"], [], [], False
                if r["rank"] == 0:
                    known.append(_unpack(r["known"], np.int64))
                    logs.append(_unpack(r["logs"], np.float32))
                    continue
                if not closed:
                    counts, values, closed = np.concatenate(known), np.concatenate(logs).astype(np.float64), True
                    base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
                codes = _unpack(r["codes"], np.int32)
                out.append((r["doc_id"], r["held_out"], len(codes), int((counts[codes] > 0).sum()), float(base[codes].sum()), float(values[codes].sum())))
            yield _rows(names, out)

    return score


#: Shuffle files of a finished write go at once: every sweep shuffles the whole state.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _learned(docs: DataFrame, folds: int, held: int, seed: int) -> tuple[DataFrame, str, Model]:
    """The blocks (of kind "text" only), the path of all answers and the first totals."""
    spark = docs.sparkSession
    parts = int(max(4, docs.count() // PART_DOCS))
    path = scratch_path(spark, "blocks")
    encode_blocks(docs, parts, held, folds).write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    pairs = blocks.where("kind = 'pair'").select("block", "part", "words", "sizes", "cids", "ctx", "train")
    dealt = pairs.repartition("part").sortWithinPartitions("part", "block")
    state_path = scratch_path(spark, "seating")
    dealt.mapInArrow(_merged, _STATE).write.option("compression", "uncompressed").parquet(state_path)
    state = spark.read.schema(_STATE).parquet(state_path)
    models = [_totals(state)]
    for number in range(BURN_IN + SAMPLES + 1):
        next_path = scratch_path(spark, "seating")
        _sweep(state, models[-1], number, seed, parts).write.option("compression", "uncompressed").parquet(next_path)
        state = spark.read.schema(_STATE).parquet(next_path)
        delete_path(spark, state_path)
        state_path = next_path
        if number < BURN_IN + SAMPLES:
            models.append(_totals(state))
    samples = models[BURN_IN + 1:]
    model = state.select("part", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("block"), "words", "sizes", "cids", "ctx", "c", "seats")
    asked = pairs.select("part", F.lit(1).alias("rank"), "block", "words", "sizes", "cids", "ctx", F.lit(None).cast("binary").alias("c"), F.lit(None).cast("array<binary>").alias("seats"))
    answer_path = scratch_path(spark, "answers")
    model.unionByName(asked).repartition("part").sortWithinPartitions("part", "rank", "block").mapInArrow(
        lambda batches: _answers(batches, samples), _ANSWER_SCHEMA).write.option("compression", "uncompressed").parquet(answer_path)
    delete_path(spark, state_path)
    delete_path(spark, f"{path}/kind=pair")
    return blocks, answer_path, models[0]


def score_texts(docs: DataFrame, folds: int = 5, held: int = 1, seed: int = 31) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity.

    The model learns from all rows but those with crc32(doc_id as text) mod ``folds`` =
    ``held`` (a null id is never held out).  Null and empty texts are one end token.
    base_score is the unigram score with half a count added; score is the model's log10
    probability.  Repeated rows are learned from and scored as often as they come.  Without
    any training row every token is the unseen word.  Other columns are ignored.
    """
    spark = docs.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        blocks, answer_path, first = _learned(docs, folds, held, seed)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    answers = spark.read.schema(_ANSWER_SCHEMA).parquet(answer_path)
    texts = blocks.where("kind = 'text'").select(
        "block", F.lit(None).cast("bigint").alias("part"), F.lit(1).alias("rank"), F.lit(None).cast("binary").alias("known"),
        F.lit(None).cast("binary").alias("logs"), "doc_id", "held_out", "codes")
    n, v = first.tokens, first.classes.types
    scored = answers.unionByName(texts).repartition("block").sortWithinPartitions("block", "rank", "part").mapInArrow(
        _scored(n, v), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
