"""Product quantisation of vectors, learnt by exact rounds that skip what bounds rule out.

Vectors become integers and are cut into equal consecutive parts.  Each part has a codebook
of entries; a round assigns every part to its nearest entry and moves each entry to the floor
of its parts' mean.

Norm-of-sum bounds: the codebooks of all rounds are kept (their number and size are fixed).
A row keeps, per part and group of entries, a lower bound on the distance to the group's
entries other than its own, stamped with the round it was measured in.  In round r the bound
has sunk by the largest net displacement |C_r - C_stamp| of the group's entries, which is never more
than the sum of their moves in between.  A group whose bound still lies above the distance to
the row's own entry can't hold a nearer or equal one; the others are scanned exactly, and
their bounds are measured and stamped anew.

Distances are exact integers, so ties and results don't depend on partitions or retries.  A
round is one pass that writes the rows' state and each task's sums; the driver sees codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.llm.common import delete_path, stored
from tripwise.session import scratch_path

#: Integer components stay below this, so that squared distances of usual dimensions fit 64 bits.
LARGEST = 1 << 28


@dataclass(frozen=True)
class Quantizer:
    """Parts of a vector, entries of a codebook, rounds, scale of the components, groups of entries with a bound."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    groups: int = 8


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: through products of doubles where they are
    exact, else one by one in 64 bits."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 1 << 53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - c[None, :, i]) ** 2
    return out


def _edges(entries: int, groups: int) -> list[tuple[int, int]]:
    cuts = [entries * g // groups for g in range(groups + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def displacements(history: list[np.ndarray], groups: int) -> np.ndarray:
    """[stamp, part, group]: the farthest that an entry of the group lies from where it was."""
    now = history[-1].astype(np.float64)
    net = np.stack([np.sqrt(((now - then) ** 2).sum(axis=2)) for then in history])
    return np.stack([net[:, :, lo:hi].max(axis=2, initial=0.0) for lo, hi in _edges(now.shape[1], groups)], axis=2)


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray | None, low: np.ndarray, stamp: np.ndarray, sunk: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every row of one part (ties to the lower index) and its squared distance.

    ``code`` is the assignment before (None: none yet).  ``low`` and ``stamp`` (rows by
    groups) are brought up to date in place.  Also how many groups of rows were scanned.
    """
    groups = _edges(len(book), low.shape[1])
    n = len(x)
    if code is None:
        old = None
        best, dist = np.full(n, len(book), np.int64), np.full(n, np.iinfo(np.int64).max)
        scan = np.ones(low.shape, bool)
    else:
        old = code.astype(np.int64)
        dist = ((x - book[old]) ** 2).sum(axis=1)
        best = old.copy()
        bound = low.astype(np.float64) - sunk[stamp, np.arange(low.shape[1])[None, :]]
        own = np.sqrt(dist.astype(np.float64))
        # a margin far above rounding errors: a doubtful group is scanned
        scan = ~(bound * (1 - 1e-9) - 1e-6 > own[:, None])
    own_dist = dist.copy()
    seen = []
    scanned = 0
    for g, (lo, hi) in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if lo == hi or not len(rows):
            continue
        scanned += len(rows)
        d = squares(x[rows], book[lo:hi])
        at = d.argmin(axis=1)
        first = d[np.arange(len(rows)), at]
        d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
        seen.append((g, rows, at + lo, first, d.min(axis=1)))
        better = (first < dist[rows]) | ((first == dist[rows]) & (at + lo < best[rows]))
        dist[rows[better]], best[rows[better]] = first[better], at[better] + lo
    for g, rows, entry, first, second in seen:
        rest = np.where(entry == best[rows], second, first)
        low[rows, g] = np.nextafter(np.sqrt(rest.astype(np.float64)).astype(np.float32), np.float32(0))
        stamp[rows, g] = now
    if old is not None:
        # an entry that was given up counts among its group's others from now on
        group_of = np.zeros(len(book), np.int64)
        for g, (lo, hi) in enumerate(groups):
            group_of[lo:hi] = g
        rows = np.flatnonzero(best != old)
        rows = rows[~scan[rows, group_of[old[rows]]]]
        g = group_of[old[rows]]
        held = np.minimum(bound[rows, g] * (1 - 1e-9) - 1e-6, np.sqrt(own_dist[rows].astype(np.float64)))
        low[rows, g] = np.nextafter(np.maximum(held, 0).astype(np.float32), np.float32(0))
        stamp[rows, g] = now
    return best, dist, scanned


def _kept(rows: DataFrame, q: Quantizer) -> tuple[DataFrame, int, np.ndarray]:
    """Usable rows as (vec_id, label, v), their dimension, and the first codebook [part, entry, place]."""
    vector = F.col("embedding")
    bound = LARGEST / q.scale
    # NaN is above all numbers, infinities are beyond the bound
    usable = rows.where(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % q.parts == 0)).where(
        F.forall(vector, lambda x: x.isNotNull() & (x.cast("double") < bound) & (x.cast("double") > -bound)))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * q.scale).try_cast("int"))
    told = usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", ints.alias("v"))
    # the least of all rows fixes the dimension
    head = told.select("vec_id", F.size("v").alias("n"), "v").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = head.limit(1).collect()
    if not first:
        return told, 0, np.zeros((q.parts, 0, 0), np.int64)
    dim = first[0]["n"]
    told = told.where(F.size("v") == dim)
    start = head.where(F.col("n") == dim).limit(q.entries).collect()
    book = np.array([r["v"] for r in start], np.int64).reshape(len(start), q.parts, dim // q.parts).transpose(1, 0, 2)
    return told, dim, book


def _state(label: T.DataType) -> T.StructType:
    bigints = T.ArrayType(T.LongType())
    return T.StructType([T.StructField(n, t) for n, t in (
        ("vec_id", T.LongType()), ("label", label), ("v", T.BinaryType()), ("code", T.BinaryType()), ("low", T.BinaryType()),
        ("stamp", T.BinaryType()), ("error", T.LongType()), ("place", T.IntegerType()), ("n", T.LongType()), ("sums", bigints))])


def _pass(source: DataFrame, q: Quantizer, dim: int, history: list[np.ndarray], schema: T.StructType) -> DataFrame:
    """Assign all rows to the last codebook; then each task's sums per part and entry."""
    sunk = displacements(history, q.groups)
    books, now, width = history[-1], len(history) - 1, dim // q.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.shape[1]
        sums, counts = np.zeros((q.parts, entries, width), np.int64), np.zeros((q.parts, entries), np.int64)
        names = schema.names
        kind = None
        for b in batches:
            n = b.num_rows
            kind = b["label"].type
            fresh = "code" not in b.schema.names
            if fresh:
                x = b["v"].flatten().to_numpy().astype(np.int64).reshape(n, dim)
                low, stamp, codes = np.zeros((n, q.parts, q.groups), np.float32), np.zeros((n, q.parts, q.groups), np.uint8), None
            else:
                x = np.frombuffer(b"".join(b["v"].to_pylist()), "<i4").astype(np.int64).reshape(n, dim)
                low = np.frombuffer(b"".join(b["low"].to_pylist()), "<f4").reshape(n, q.parts, q.groups).copy()
                stamp = np.frombuffer(b"".join(b["stamp"].to_pylist()), np.uint8).reshape(n, q.parts, q.groups).copy()
                codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint16).reshape(n, q.parts)
            new, error = np.zeros((n, q.parts), np.uint16), np.zeros(n, np.int64)
            for p in range(q.parts):
                part = x[:, p * width:(p + 1) * width]
                best, dist, _ = assign(part, books[p], None if codes is None else codes[:, p], low[:, p], stamp[:, p], sunk[:, p], now)
                new[:, p] = best
                error += dist
                counts[p] += np.bincount(best, minlength=entries)
                for i in range(width):  # sums of one batch are exact in doubles
                    sums[p, :, i] += np.bincount(best, weights=part[:, i].astype(np.float64), minlength=entries).astype(np.int64)
            blobs = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype("<i4"), new, low, stamp)]
            v, code, lows, stamps = blobs
            blank = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], v, code, lows, stamps, pa.array(error), *blank], names=names)
        if kind is not None:
            used = np.argwhere(counts > 0)
            m = len(used)
            blank = [pa.nulls(m, k) for k in (pa.int64(), kind, pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            told = [pa.array(used[:, 0] * entries + used[:, 1], pa.int32()), pa.array(counts[used[:, 0], used[:, 1]]), pa.array(list(sums[used[:, 0], used[:, 1]]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*blank, *told], names=names)

    return source.mapInArrow(run, schema)


def _moved(sums: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: floors of means; entries without parts stay."""
    width = book.shape[2]
    total = sums.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = book.copy()
    for r in total.collect():
        out[r["place"] // book.shape[1], r["place"] % book.shape[1]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def learn_codes(rows: DataFrame, q: Quantizer = Quantizer()) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable rows (vec_id, label, embedding; other columns are ignored).

    Returns a table (vec_id, label, code: one 16-bit number per part, error) and the final
    codebooks [part, entry, place].  Left out: null and empty vectors, those with null or non-finite
    components or with components of LARGEST and more once scaled, and those whose length
    is no multiple of the parts or differs from that of the row with the least vec_id.  Null
    vec_ids come last in that order; repeated rows count as often as they occur.  With
    fewer rows than entries the codebooks are smaller; without rows both results are empty.
    """
    spark = rows.sparkSession
    told, dim, book = _kept(rows, q)
    schema = _state(rows.schema["label"].dataType)
    if not dim:
        return spark.createDataFrame([], schema).select("vec_id", "label", "code", "error"), book
    history, source, last = [book], told, None
    for r in range(q.rounds + 1):
        path = scratch_path(spark, "codes")
        _pass(source, q, dim, history, schema).write.option("compression", "zstd").parquet(path)
        if last is not None:
            delete_path(spark, last)
        last = path
        written = spark.read.schema(schema).parquet(path)
        if r < q.rounds:
            history.append(_moved(written.where("place is not null").select("place", "n", "sums"), history[-1]))
        source = written.where("place is null").select("vec_id", "label", "v", "code", "low", "stamp")
    return written.where("place is null").select("vec_id", "label", "code", "error"), history[-1]


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, q: Quantizer = Quantizer()) -> DataFrame:
    """vec_id, code (hex), error, label_error (errors of equal labels summed, nulls together)
    and the digest of the codebooks; one row per usable row."""
    codes, books = learn_codes(rows, q)
    # the low bytes of 16-bit numbers
    digits = F.concat(*[F.substring(F.hex("code"), 1 + 4 * p, 2) for p in range(q.parts)])
    told = codes.select("vec_id", "label", F.lower(digits).alias("code"), "error")
    # written first, so that its size decides how it is joined
    sums = stored(told.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    both = told.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
