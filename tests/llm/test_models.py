"""Trained operators: held-out accuracy, identities, exact counts, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tripwise.llm import language_model, quality, toxicity
from tripwise.llm.hashing import pieces, word_hashes

FOLDER = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def held_out(spark, rows, label):
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = [(r, known[r["doc_id"]]) for r in rows if r["held_out"] and known.get(r["doc_id"]) is not None]
    return [r for r, _ in kept], [y for _, y in kept]


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    ids, vals = np.arange(7), rng.random(7)
    width = (1 << quality.BITS) + quality.STATISTICS * quality.BINS
    m = quality.FactorisationMachine(0.3, rng.normal(size=width), rng.normal(size=(width, quality.FACTORS)) * 0.2)
    slow = 0.3 + sum(m.linear[i] * x for i, x in zip(ids, vals, strict=True))
    slow += sum(m.factors[i] @ m.factors[j] * vals[i] * vals[j] for i in range(7) for j in range(i))
    assert abs(m.score(ids, vals) - 1 / (1 + math.exp(-slow))) < 1e-9


def test_quality_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    kept, y = held_out(spark, rows, "quality")
    assert auc([r["score"] for r in kept], y) > 0.9


def test_toxicity_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["severity"] <= toxicity.GRADES - 1 and r["rejected"] == (r["p_toxic"] >= 0.5) for r in rows)
    kept, y = held_out(spark, rows, "toxic")
    assert auc([r["severity"] for r in kept], y) > 0.8
    assert sum(r["rejected"] for r, t in zip(kept, y, strict=True) if not t) <= 0.03 * len(y)


def test_ordered_thresholds_and_shared_weights():
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        texts.append(" ".join([f"word{rng.randrange(300)}" for _ in range(30)] + ["foul", "nasty"] * (rng.randrange(1, 6) if bad else 0)))
        labels.append(int(bad))
    encoded = [toxicity._encode(t, None) for t in texts]
    m = toxicity.fit(np.array(labels), [i for i, _ in encoded], [c for _, c in encoded])
    assert (np.diff(m.thresholds) > 0).all()
    p = m.grades(np.array([m.linear(t) for t in ("word1 word2", "foul", "foul nasty " * 2, "foul nasty " * 5, "", None)]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    severity = p @ np.arange(toxicity.GRADES)
    assert severity[0] < 0.2 < severity[2] < severity[3] and severity[4] == severity[5]


def test_models_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, odd):
        assert quality.quality(odd_docs, labels).where("score between 0 and 1").count() == odd_docs.count()
        assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert {r["score"] for r in quality.quality(odd_docs, none).collect()} == {0.5}
    assert toxicity.toxicity(odd_docs, none).where("rejected").count() == 0
    assert quality.quality(no_docs, odd).count() == 0 and toxicity.toxicity(no_docs, none).count() == 0


def test_word_hashes_follow_words():
    texts = ["Hello  World\tfoo", None, "", "a", "  x y ", "\u00e9 HELLO", "foo", "\u00c9", "a" * 3_000_000 + " b"]
    found = {}
    seen = []
    for first, data, offsets in pieces(pa.array(texts)):
        h, bounds, at, to, low = word_hashes(data, offsets)
        for r in range(len(offsets) - 1):
            words = [low[at[i]:to[i]].tobytes() for i in range(bounds[r], bounds[r + 1])]
            assert words == (texts[first + r] or "").encode().lower().split()
            for w, x in zip(words, h[bounds[r]:bounds[r + 1]], strict=True):
                assert found.setdefault(w, x) == x
            seen.append(first + r)
    assert seen == list(range(len(texts))) and len(set(found.values())) == len(found)


def test_language_model_counts(spark, odd_docs, odd_documents, monkeypatch):
    """Counts and base scores are exact over many small blocks and parts."""
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t, *_ in odd_documents]
    c = Counter()
    for d, w in tokens:
        if d is None or fold(d, 5) != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    rows = language_model.score_texts(odd_docs).collect()
    want = Counter((d, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d, w in tokens)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n} and all(r["score"] <= 0 and r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"], 5) == 1) for r in rows)


def test_language_model_beats_the_unigram(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language_model.score_texts(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_language_model_of_nothing(spark, no_docs):
    assert language_model.score_texts(no_docs).count() == 0
    held = [i for i in range(60) if fold(i, 5) == 1][:3]
    only = spark.createDataFrame([(i, "a b") for i in held], "doc_id bigint, text string")
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9 for r in language_model.score_texts(only).collect())


def test_seating_conditionals():
    """Redrawn tables follow the exact conditional, found here by enumerating seatings."""
    d, total = 0.5, language_model.Totals(np.array([9.0, 4.0]), np.array([6.0, 3.0]), 4.0, 0.5, 0.5)
    size, n = 4, 40_000
    monkey = language_model.CONTEXTS
    assert monkey >= 2
    c = np.full(n, size)
    t = np.ones(n, np.int64)
    ctx = np.zeros(n, np.uint8)
    got = language_model.resample(c, t, ctx, np.arange(n), n, total, np.random.default_rng(5))
    parent = (1 - total.d0) / (language_model.STRENGTH + total.root)
    weight = np.zeros(size + 1)

    def seat(tables, p, k):
        if k == size:
            weight[len(tables)] += p
            return
        for i, x in enumerate(tables):
            seat(tables[:i] + [x + 1] + tables[i + 1:], p * (x - d), k + 1)
        seat(tables + [1], p * (language_model.STRENGTH + d * (5 + len(tables))) * parent, k + 1)

    seat([1], (language_model.STRENGTH + d * 5) * parent, 1)
    want = weight[1:] / weight.sum()
    assert np.abs(np.bincount(got, minlength=size + 1)[1:] / n - want).max() < 0.01


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words = 50
    c = rng.integers(0, 4, (words, 3))
    c[:, 0] += 1
    t = np.minimum(c, 1)
    wi, ctx = np.repeat(np.arange(words + 1), 3), np.tile(np.arange(3, dtype=np.uint8), words + 1)
    flat_c, flat_t = np.append(c.ravel(), [0, 0, 0]), np.append(t.ravel(), [0, 0, 0])
    total = language_model.Totals(c.sum(axis=0).astype(float), t.sum(axis=0).astype(float), float(words), 0.6, 0.4)
    p = language_model.predictive(flat_c, flat_t, ctx, wi, words + 1, total)
    assert np.allclose([p[ctx == u].sum() for u in range(3)], 1)


def test_language_model_tells_long_contexts_apart(spark):
    """Two previous words with one ending, so of one class, keep what follows each of them."""
    rows = [(i, "redding alpha" if i % 2 else "walking omega") for i in range(400)]
    asked = [i for i in range(400, 2000) if fold(i, 5) == 1][:4]
    texts = ["redding alpha", "redding omega", "walking omega", "walking alpha"]
    docs = spark.createDataFrame(rows + list(zip(asked, texts, strict=True)), "doc_id bigint, text string")
    score = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs).collect()}
    a, b, c, d = (score[i] for i in asked)
    assert a > b + 1 and c > d + 1


def test_probabilities_of_words_after_words_sum_to_one():
    rng = np.random.default_rng(6)
    words, cids = 40, np.array([0, 65, 129, 130], np.int64)
    c = rng.integers(0, 4, (words + 1, 4))
    c[:words, 0] += 1
    c[words] = 0
    t = np.minimum(c, 1).ravel()
    wi, ctx = np.repeat(np.arange(words + 1), 4), np.tile(np.arange(4), words + 1)
    kind, kwi, back = language_model._classes(wi, ctx, cids)
    assert set(kind) == {0, 1, 2}
    kc = np.bincount(back, t, len(kind)).astype(np.int64)
    kt = np.minimum(kc, 1)
    sums = [np.bincount(kind, x, language_model.CONTEXTS) for x in (kc, kt)]
    classes = language_model.Totals(*sums, float(words), 0.6, 0.4)
    total = language_model.Totals(np.bincount(ctx, c.ravel(), 4), np.bincount(ctx, t, 4), float(words), 0.7, 0.4)
    parent = language_model.predictive(kc, kt, kind, kwi, words + 1, classes)
    p = language_model.seated(c.ravel(), t, ctx, parent[back], total)
    assert np.allclose([p[ctx == u].sum() for u in range(4)], 1)


def test_seating_of_many_customers():
    """Redrawn tables follow exact Stirling weights whatever the number of customers."""
    for c, d, others, parent in ((33, 0.8, 5000, 1e-3), (200, 0.8, 5000, 1e-3), (1000, 0.8, 50_000, 1e-3), (1000, 0.8, 50_000, 1e-4),
                                 (1500, 0.8, 5000, 1e-3), (1500, 0.5, 50_000, 1e-2), (1500, 0.8, 5_000_000, 1e-3)):
        tables = np.arange(1, c + 1)
        w = language_model.log_stirling(d, c)[c, 1:] + np.cumsum(np.log(language_model.STRENGTH + d * (others + tables - 1)) + np.log(parent))
        w = np.exp(w - w.max())
        mean = (w * tables).sum() / w.sum()
        sd = math.sqrt((w * (tables - mean) ** 2).sum() / w.sum())
        n = 1500
        total = language_model.Totals(np.array([1e6]), np.array([others + 1.0]), 10.0, d, 0.5)
        got = language_model.redraw(np.full(n, c), np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, parent), total, np.random.default_rng(8))
        assert abs(got.mean() - mean) < 4 * sd / math.sqrt(n) and 0.9 < got.std() / sd < 1.1


def test_numbers_of_many_customers():
    for d in (0.05, 0.5, 0.95):
        c, t = 1200, np.arange(1, 1201)
        want = language_model.log_stirling(d, c)[c, 1:] + t * math.log(d) + np.array([math.lgamma(x + 1) for x in t]) - math.lgamma(c + 1)
        assert np.abs(language_model._log_sizes(d, np.full(c, c), t) - want).max() < 1e-3
