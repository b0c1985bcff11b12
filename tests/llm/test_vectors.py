"""Hard negatives and vector codes against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwise.llm import hard_negatives as hn
from tripwise.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, width string, code int, score double, rank int, v int, window int, block int"
EXTRA = (1, "w", 2, 0.5, 3, 4, 5, 6)


def odd_vectors(dim, n, seed, labels=3):
    """Clusters, equal vectors, negative scores, nulls, odd numbers, other lengths, repeated rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = centres[i % 5]
        v = list(c) if i % 6 == 0 else [x + rng.gauss(0, 0.05) for x in c]
        rows.append((i, [float(np.float32(x)) for x in v], 0 if rng.random() < 0.4 else rng.randrange(labels)))
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [None] * dim, 1), (n + 3, [math.nan] * dim, 1), (n + 4, [math.inf] * dim, 1), (n + 5, [0.1] * (dim + 4), 1)]
    rows += [(n + 6, [3.0e38] * dim, 1), (n + 7, rows[0][1], None), (None, rows[3][1], 1), rows[1], rows[1], (2, rows[7][1], 2), (n + 8, [-x for x in rows[0][1]], 0)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def brute_negatives(rows, dim, anchors, how):
    usable = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
              if i is not None and lab is not None and v and len(v) == dim and all(x is not None and abs(x) < hn.LARGEST / 256 for x in v)}
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    for a in (u for u in usable if anchors(u[0])):
        same = sorted((-dot(a, b), b[0]) for b in usable if b[1] == a[1] and b != a)[:how.positives]
        for s, p in same:
            fits = sorted((-dot(a, b), b[0]) for b in usable if b[1] != a[1] and how.low * -s <= 100 * dot(a, b) <= how.high * -s)
            for r, (t, b) in enumerate(fits[:how.negatives]):
                out[a[0], p, r + 1, b, -s, -t] += 1
    return out


@pytest.mark.parametrize("how", [hn.Mining(), hn.Mining(3, 7, 50, 90)])
def test_hard_negatives(spark, monkeypatch, how):
    rows = odd_vectors(6, 400, 1)
    monkeypatch.setattr(hn, "TILE", 64)
    monkeypatch.setattr(hn, "LEAF", 8)
    monkeypatch.setattr(hn, "SLAB", 150)
    vectors = hn.integer_vectors(frame(spark, rows))
    got = hn.mine(vectors, F.col("vec_id") % 9 == 0, how, block=20)
    assert got.columns == [c.split()[0] for c in hn._FOUND.split(", ")]
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, 6, lambda i: i % 9 == 0, how)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hn.mine(hn.integer_vectors(none), F.col("vec_id") % 2 == 0).count() == 0
    assert vc.compressed(none).count() == 0
    lone = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1, *EXTRA)], SCHEMA)
    assert hn.mine(hn.integer_vectors(lone), F.col("vec_id") == 1).count() == 0


def test_intervals_hold_all_products():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-50, 50, (40, 5)), rng.integers(-50, 50, (30, 5))
    least, most = hn.intervals(q, v.min(axis=0)[None, :], v.max(axis=0)[None, :])
    assert (least <= (q @ v.T).min(axis=1, keepdims=True)).all() and (most >= (q @ v.T).max(axis=1, keepdims=True)).all()


def test_large_numbers_stay_exact():
    a = np.array([[hn.LARGEST - 1] * 16], np.int64)
    assert hn.products(a, a)[0, 0] == 16 * (hn.LARGEST - 1) ** 2
    b = np.array([[vc.LARGEST - 1] * 16, [1] * 16], np.int64)
    assert vc.squares(-b, b)[0].tolist() == [16 * (2 * vc.LARGEST - 2) ** 2, 16 * vc.LARGEST**2]


def brute_codes(rows, dim, q):
    key = lambda r: (2**63 if r[0] is None else r[0], r[1])
    kept = [(i, v, lab) for i, v, lab in rows if v and len(v) == dim and all(x is not None and abs(x) < vc.LARGEST / q.scale for x in v)]
    kept = sorted(((i, tuple(math.floor(q.scale * x) for x in v), lab) for i, v, lab in kept), key=key)
    w = dim // q.parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[list(cut(r[1], p)) for r in kept[:q.entries]] for p in range(q.parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), j) for j, c in enumerate(books[p]))

    for _ in range(q.rounds):
        for p in range(q.parts):
            groups = defaultdict(list)
            for r in kept:
                groups[nearest(r[1], p)[1]].append(cut(r[1], p))
            for j, members in groups.items():
                books[p][j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, sums = [], Counter()
    for i, v, lab in kept:
        found = [nearest(v, p) for p in range(q.parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
        sums[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, sums[lab], digest) for i, c, e, lab in out)


@pytest.mark.parametrize("q", [vc.Quantizer(entries=20, groups=4), vc.Quantizer(parts=2, entries=256, rounds=3), vc.Quantizer(entries=7, rounds=9, groups=8)])
def test_vector_codes(spark, q):
    rows = odd_vectors(8, 300, 4)
    got = vc.compressed(frame(spark, rows), q)
    assert Counter(tuple(r) for r in got.collect()) == brute_codes(rows, 8, q)


def test_bounds_skip_scans_and_lose_nothing():
    """Rounds of one part in memory: bounds never lie, and most groups need no scan in the end."""
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 400, (40, 4))[rng.integers(0, 40, 3000)] + rng.normal(0, 30, (3000, 4))).astype(np.int64)
    history, code = [x[:32][None].copy()], None
    low, stamp = np.zeros((3000, 8), np.float32), np.zeros((3000, 8), np.uint8)
    scans = []
    for r in range(8):
        sunk = vc.displacements(history, 8)[:, 0]
        code, dist, scanned = vc.assign(x, history[-1][0], code, low, stamp, sunk, r)
        d = ((x[:, None, :] - history[-1][0][None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
        others = np.where(np.arange(32)[None, :] == code[:, None], np.inf, np.sqrt(d)).reshape(3000, 8, 4).min(axis=2)
        assert (low.astype(float) - sunk[stamp, np.arange(8)[None, :]] <= others + 1e-6).all()
        scans.append(scanned)
        book = history[-1].copy()
        for j in range(32):
            if (code == j).any():
                book[0, j] = x[code == j].sum(axis=0) // (code == j).sum()
        history.append(book)
    assert scans[-1] < scans[0] / 3
