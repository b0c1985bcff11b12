"""Token shards against the tokenizer called text by text."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tripwise.llm import token_shards as ts
from tripwise.session import scratch_path

FILE = public_tokenizers.path("byte_bpe_50k.json")
BIG = 2**63 - 1


def direct(rows, file=FILE, end=0):
    """Expected (doc_id, start, n, crc) in the dataset's order; rows of equal ids in any."""
    t = Tokenizer.from_file(file)
    at, out = 0, []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def told(df):
    return [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in df.collect()]


def test_words_are_encoded_as_whole_texts_are():
    rng = random.Random(1)
    plain = ["a", "s", "t", "re", "ll", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "23", "!", "?!", "é", "ſ", "the", " and", "d", "m", "ve"]
    odd = [*plain, "×", "µ", "“", "中", " ", "​", "<|endoftext|>", "Ж", "\x00", "\x1c", " ", "́", "²"]
    texts = ["".join(rng.choice(odd if i % 2 else plain) for _ in range(rng.randrange(30))) for i in range(6000)]
    texts += [None, "", "x" * 5000, "ab'sc " * 2000, "  " * 999]
    encoder = ts._Encoder(ts.Encoding(FILE))
    assert encoder.by_word
    t = Tokenizer.from_file(FILE)
    for text, ids in zip(texts, encoder.documents(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0], text


def test_pieces_are_those_of_the_pattern():
    pattern = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab s'tlredv 1!\n\t ") for _ in range(rng.randrange(12))) for _ in range(5000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts = np.flatnonzero(ts.piece_starts(data, bounds)).tolist()
    want = [int(bounds[i]) + m.start() for i, t in enumerate(texts) for m in pattern.finditer(t)]
    assert starts == want


def test_other_tokenizers_are_asked_text_by_text():
    encoding = ts.Encoding(public_tokenizers.path("word_bpe_49k.json"), end_id=49407)
    encoder = ts._Encoder(encoding)
    assert not encoder.by_word
    t = Tokenizer.from_file(encoding.file)
    (got,) = encoder.documents(["Two  WORDS here"])
    assert np.frombuffer(got, "<u2").tolist() == [*t.encode("Two  WORDS here", add_special_tokens=False).ids, 49407]


def test_a_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 7, 100, 5000):
        h1, h2 = ts._key_hashes(rng.integers(-9, 10**12, m), np.zeros(m, bool), np.arange(m))
        pilots, slots = ts.perfect_hash(h1, h2)
        assert sorted(slots.tolist()) == list(range(m))
        p = pilots[ts._bucket_of(h1, h2, len(pilots))]
        assert (np.where(p < 0, -1 - p.astype(np.int64), ts._slots(h1, h2, np.maximum(p, 0), m)) == slots).all()


def test_documents_come_back(spark, odd_docs, odd_documents):
    """Small shards, repeated and null ids that cross them, long texts."""
    path = scratch_path(spark, "tokens")
    ts.write_dataset(odd_docs, path, ts.Encoding(FILE), shard_ids=300)
    got = told(ts.lookup(spark, path, ts.document_keys(odd_docs)))
    assert len(got) == len(odd_documents)
    starts = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in starts] == sorted((r[0] for r in odd_documents), key=lambda d: BIG if d is None else d)
    at = 0
    for _, start, n, _ in starts:
        assert start == at
        at += n
    want = {(d, n, crc) for d, _, n, crc in direct([r[:2] for r in odd_documents])}
    assert {(d, n, crc) for d, _, n, crc in got} == want
    # a shard's ids lie at its start, as plain numbers
    shards = ts._shards(spark, path).orderBy("shard").collect()
    raw = [np.frombuffer(bytes(r["content"]), "<u2")[:len(ts._parsed(bytes(r["content"]))[0])] for r in shards]
    assert len(shards) > 5 and zlib.crc32(np.concatenate(raw)[:at].astype("<u4").tobytes()) == zlib.crc32(b"".join(
        bytes(r["ids"]) for r in ts.lookup(spark, path, ts.document_keys(odd_docs)).orderBy("start").collect()))


def test_keys_without_documents_find_nothing(spark, odd_docs):
    path = scratch_path(spark, "tokens")
    ts.write_dataset(odd_docs, path, ts.Encoding(FILE), shard_ids=1000)
    absent = spark.createDataFrame([(10**9 + i, 0) for i in range(3000)] + [(5, 7), (0, 0), (0, 0)], "doc_id bigint, copy bigint")
    assert [r["doc_id"] for r in ts.lookup(spark, path, absent).collect()] == [0]
    few = ts.fetch(spark, path, [3, 204, 10**9])
    assert sorted(r["doc_id"] for r in few.collect()) == [3, 204]
    assert ts.fetch(spark, path, [10**9]).count() == 0


def test_end_ids_of_any_size(spark):
    docs = spark.createDataFrame([(1, "one"), (2, None), (0, "!!")], "doc_id bigint, text string")
    path = scratch_path(spark, "tokens")
    ts.write_dataset(docs, path, ts.Encoding(FILE, end_id=70_000))
    got = told(ts.lookup(spark, path, ts.document_keys(docs)))
    assert sorted(got) == direct([(0, "!!"), (1, "one"), (2, None)], end=70_000)


def test_no_documents(spark, no_docs):
    path = scratch_path(spark, "tokens")
    ts.write_dataset(no_docs, path, ts.Encoding(FILE))
    assert ts.lookup(spark, path, ts.document_keys(no_docs)).count() == 0
    assert ts.fetch(spark, path, [1]).count() == 0


def test_damage_is_noticed():
    shard = ts._shard([b"\x01\x00\x02\x00"], [(7, 2, 0)], 2) + ts.MAGIC.encode()
    ids, entries = ts._parsed(shard)
    assert ids.tolist() == [1, 2] and entries["doc_id"].tolist() == [7]
    for broken in (shard[:-1], shard[2:]):
        with pytest.raises(ValueError):
            ts._parsed(broken)
