"""Winnowing and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter

from tripwise.llm import mixing, winnow
from tripwise.llm.common import ascii_lower

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_only_ascii_letters_are_lowered(spark):
    texts = ["ABC", "\u00c9A", "\u0130X", "\u212aK", "\u24b6B", "stra\u00dfe A", "\u03a3\u03a3 A", "", "\u4e2dA", "\U0001f600Z", "\u01c5A"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ascii_lower(df["t"])).collect()] == [lower(t) for t in texts]


def brute(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = WORDS.findall(lower(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = Counter()
    for d, t in docs:
        w = WORDS.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                own = grams.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out[d, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def fixture():
    rng = random.Random(8)
    say = lambda n, k=30: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((30, 13, 14, 12, 9, 6, 5, 4, 3, 2, 1, 40))]
    items += [(50, items[0][1].upper() + "!"), (51, None), (52, ""), (53, "-- ..."), (54, "same same " * 10), (None, say(20)), (9, say(15))]
    texts = [None, "", "..", say(12), say(400), say(3000)]
    for _, t in items:
        w = (t or "").split()
        texts += [say(5) + "; " + (t or "") + " " + say(7), " ".join(w[1:]), " ".join(w[:13]), "\n".join(w[:7] + ["x"] + w[7:]), say(500) + " " + (t or "") * 3]
    texts += ["same " * 60, items[0][1] + " " + items[0][1], items[0][1][:-1]]
    docs = list(enumerate(texts)) + [(3, items[1][1]), (3, "w1"), (None, items[2][1]), (7, texts[7])]
    return docs, items


def test_benchmark_words(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as hash", "2 as i", "3 as item", "4 as m", "5 as _n_words")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id", "2 as k1")
    got = winnow.decontaminate(d, b).drop("item_ids")
    assert Counter(map(tuple, got.collect())) == brute(docs, items)
    clean = winnow.clean_documents(d, b)
    assert clean.columns == d.columns and clean.count() == sum(n for r, n in brute(docs, items).items() if not r[-1])


def test_documents_are_winnowed_for_large_benchmarks_only(spark, monkeypatch):
    """Windows are chosen from (a sliding minimum per word) where the benchmark can't be sent."""
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    chosen = []
    choose = winnow.fingerprints
    monkeypatch.setattr(winnow, "fingerprints", lambda df, t, at: chosen.append(at) or choose(df, t, at))
    winnow.judge(d, b)
    assert set(chosen) == {"j"}
    monkeypatch.setattr(winnow, "SENT_WORDS", 0)
    got = winnow.decontaminate(d, b).drop("item_ids")
    assert set(chosen) == {"i", "j"} and Counter(map(tuple, got.collect())) == brute(docs, items)


def test_benchmark_words_of_nothing(spark, no_docs):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert winnow.decontaminate(no_docs, b).count() == 0
    assert Counter(map(tuple, winnow.decontaminate(d, b.limit(0)).drop("item_ids").collect())) == brute(docs, [])


def targets(rows, most=3.0):
    size = Counter()
    for s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        level = (sum(size.values()) - sum(most * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > most * size[s]}
        if not more:
            return {s: most * size[s] if s in full else level * weight[s] for s in names}, size
        full |= more


def test_mix(spark, odd_docs, odd_documents):
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want, size = targets([(r[3], words(r[1])) for r in odd_documents])
    got = mixing.pareto_mix(odd_docs).collect()
    assert Counter((r["doc_id"], r["source"], r["_size"]) for r in got) == Counter((r[0], r[3], words(r[1])) for r in odd_documents)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["_source_size"] == size[r["source"]] and abs(r["_target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and 0 <= r["_copies"] <= 3
        taken[r["source"]] += r["_copies"] * r["_size"]
        largest[r["source"]] = max(largest[r["source"]], r["_size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.pareto_mix(odd_docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["text"], r["_copies"]) for r in again) == Counter((r["doc_id"], r["text"], r["_copies"]) for r in got)


def test_mix_at_size(spark):
    """Sums meet the targets closely, and boosted rows are taken more often."""
    from pyspark.sql import functions as F

    df = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "concat('s', case when id % 10 < 4 then 0 else id % 10 end) as source")
    got = mixing.pareto_mix(df, boost=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    rows = got.groupBy("source").agg(F.first("_target").alias("t"), F.sum(F.col("_copies") * F.col("_size")).alias("w"),
                                     F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("_copies"))).alias("even"), F.avg(F.when(F.col("doc_id") % 2 == 1, F.col("_copies"))).alias("odd")).collect()
    assert all(abs(r["t"] - r["w"]) <= 50 for r in rows)
    part = [r for r in rows if r["even"] is not None and r["odd"] is not None and r["t"] % 1 and r["even"] != r["odd"]]
    assert all(r["even"] > r["odd"] for r in part)


def test_mix_of_nothing(no_docs, spark):
    assert mixing.pareto_mix(no_docs).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id bigint, text string, source string")
    assert [r["_copies"] for r in mixing.pareto_mix(only).collect()] == [0, 0]
