"""Digest index, line runs and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tripwise.llm import digest_index, line_runs, mixing, near_dup, url_filter, winnow
from tripwise.session import scratch_path

SPACE = "[\x20\x09-\x0d]"
BIG = 2**63 - 1


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_exact_copies(spark, odd_docs, odd_documents):
    groups = defaultdict(list)
    for d, t, *_ in odd_documents:
        groups[hashlib.sha256(re.sub(SPACE, "", t or "").encode()).hexdigest()].append((-len(t or ""), BIG if d is None else d, d))
    want = Counter()
    for h, rows in groups.items():
        keep = min(rows)[2]
        for i, (_, _, d) in enumerate(sorted(rows, key=lambda r: r[:2])):
            want[d, keep, len(rows), i == 0, h] += 1
    got = Counter(tuple(r) for r in digest_index.exact_dedup(odd_docs, batches=3, buckets=4).collect())
    assert got == want


def test_exact_copies_of_nothing(no_docs):
    assert digest_index.exact_dedup(no_docs).count() == 0


def test_a_digest_index_goes_on(spark):
    """A second batch and a reopened index only add what is new."""
    path = scratch_path(spark, "index")
    schema = "digest binary, doc_id bigint, row bigint, n_chars int"
    index = digest_index.DigestIndex(spark, path, 4)
    index.add(spark.createDataFrame([(b"a", 1, 1, 5), (b"a", 2, 2, 9), (b"b", 3, 3, 1)], schema))
    index.close()
    index = digest_index.DigestIndex(spark, path, 4)
    index.add(spark.createDataFrame([(b"b", 0, 4, 99), (b"c", 7, 5, 1)], schema))
    got = {bytes(r["digest"]): r["keep_id"] for r in index.entries().collect()}
    index.close()
    assert got == {b"a": 2, b"b": 3, b"c": 7}


def test_a_reopened_index_knows_its_earlier_rows(spark):
    """The same rows again: nothing is kept a second time, counts go on, new texts are kept."""
    path = scratch_path(spark, "index")
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id bigint, text string")
    first = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in digest_index.exact_dedup(docs, path, buckets=4).collect()}
    assert first == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True)}
    more = docs.unionByName(spark.createDataFrame([(9, "d"), (0, "a  b")], docs.schema))
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in digest_index.exact_dedup(more, path, buckets=4).collect()}
    assert again == {1: (1, 5, False), 2: (1, 5, False), 3: (3, 2, False), 9: (9, 1, True), 0: (1, 5, False)}


def test_columns_named_like_generated_ones_come_back(spark, odd_docs):
    """Callers' columns of such names don't disturb an operator and keep their values."""
    names = ["p", "last", "Whole", "_src", "_hash", "_draw", "_boost", "_n", "_hit", "_ids", "_k1", "_k2", "_doc", "_text_hash", "_gone", "_lines", "_edges", "_url", "_keys"]
    own = odd_docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    items = spark.createDataFrame([("i1", "one two three"), ("i2", None)], "item_id string, text string")
    for out in (mixing.pareto_mix(own), winnow.clean_documents(own, items), line_runs.dedup_lines(own), near_dup.distinct_documents(own),
                url_filter.filter_urls(own.withColumn("url", F.lit("http://a.net/es/x")), [url_filter.Rule("block", "net", "/es/")])):
        (seen,) = out.select(*names).distinct().collect()
        assert list(seen) == [f"own {n}" for n in names]
    assert winnow.decontaminate(own, items).count() == own.count()


def brute_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), BIG), BIG if d is None else d)
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), BIG) >= (BIG if d is None else d)]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines(odd_docs, odd_documents):
    got = line_runs.dedup_lines(odd_docs, batches=5)
    assert set(odd_docs.columns) < set(got.columns)
    assert Counter(tuple(r) for r in got.select("doc_id", "_n_lines", "_n_dropped", "_kept").collect()) == brute_lines(odd_documents)


def test_lines_of_nothing(no_docs):
    assert line_runs.dedup_lines(no_docs).count() == 0


def brute_components(rows, like=near_dup.Likeness()):
    sets, ids = [], []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + like.words]) for k in range(max(1, len(w) - like.words + 1))) if w else frozenset())
        ids.append(d)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= like.percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), BIG), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))


def test_near_copies(odd_docs, odd_documents):
    got = near_dup.near_duplicates(odd_docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute_components(odd_documents)
    kept = near_dup.distinct_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    spoken = got.where("n_shingles > 0").select("label").distinct().count()
    assert kept.count() == spoken + sum(not (t or "").strip(" \t\n") for _, t, *_ in odd_documents)


def test_near_copies_at_the_threshold(spark):
    """A family with edits of all sizes, short texts, and few counters, so that all collide."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(words[: rng.choice((40, 40, 38, 12, 5, 3))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for bits in (6, None):
        got = near_dup.near_duplicates(df, bits=bits).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == brute_components(rows)


def test_hot_shingles_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 2)
    monkeypatch.setattr(near_dup, "PART", 2)
    rows = [(i, "one two three four five six seven eight nine ten " * 3 + f"tail{i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_near_copies_of_nothing(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0 and near_dup.distinct_documents(no_docs).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (100, 102), (7, 7)], "a bigint, b bigint")
    got = dict(map(tuple, near_dup.components(edges).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
