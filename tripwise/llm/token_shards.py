"""Token ids in raw binary shards, found by a minimal perfect hash of the document's key.

A dataset is a folder of three parts.

``shards``: one file per shard, documents in ascending doc_id order across files.  A file is
the ids of its documents one after the other (little-endian, 2 bytes an id where the
vocabulary allows it, else 4), each document with its end id; then 16 bytes per document
(ENTRY); then FOOTER; then MAGIC.  The ids lie at the file's start, so it can be mapped into
memory as an array.  Files are numbered by their names: task, then file of the task.

``directory`` (parquet): a row per shard with its file, counts and the ids before it.

``index`` (parquet): a row per part of the keys.  A key is (doc_id, copy), copies of one doc_id
numbered from 0.  A part is a minimal perfect hash by hash and displace: keys fall into
buckets, every bucket has a pilot that sends its keys to slots of their own, a bucket of one
key names its slot outright, and there are as many slots as keys.  A slot holds the key's
fingerprint, shard, offset and number of ids.  Any key is found by one part, one pilot and one
slot; the shard's own entry then confirms the doc_id, so a fingerprint met by chance
gives nothing wrong.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwise.llm.hashing import mixed
from tripwise.operators.ordering import running_total

#: Fixed values of the file format.  ENTRY flag 1: the doc_id is null.
MAGIC = "TOKSHARD"
ENTRY = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("flags", "<u4")])
FOOTER = np.dtype([("n_ids", "<u8"), ("n_docs", "<u4"), ("width", "<u4")])
SLOT = np.dtype([("fingerprint", "<u4"), ("n", "<u4"), ("shard", "<i8"), ("offset", "<u8")])

#: Keys per part of the index and per bucket of a part, about.
PART_KEYS = 4096
BUCKET_KEYS = 4
_FILE_BITS = 24
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 200_000
#: Words remembered by a worker (twice); bytes of texts worked on at once.
_CACHE_WORDS = 200_000
_ROUND_BYTES = 1 << 21
#: Where the byte-level scheme always parts a text.  Characters outside ASCII and the Latin
#: letters may be classed differently by libraries: texts with such are parted before white
#: space only, and those with unusual white space not at all.
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_COARSE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_NOT_FINE = re.compile(rf"[^\x00-\x7f{_LETTER}]")
_UNSURE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|[\xc4-\xc5][\x80-\xbf]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Byte-level files write printable bytes as the characters of that code, and
#: all others, in order, as the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Classes of bytes: white space, letters (every byte of a Latin letter outside ASCII too), digits, the rest.
_CLASS = np.array([0 if b in b" \t\r\n" else 1 if chr(b).isalpha() or b > 127 else 2 if 48 <= b < 58 else 3 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Encoding:
    """A tokenizer file of the tokenizers library, read by every task, and the id that ends a document."""

    file: str
    end_id: int = 0


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which bytes start a piece of the byte-level scheme, texts of plain characters given by their bounds.

    Pieces: a run of letters, digits or other signs, with one space before it; the contractions
    's 't 'm 'd 're 've 'll where no space or sign precedes; else white space, of which the last
    character before a word is a piece of its own unless it is that word's space.
    """
    n = len(data)
    kind = np.full(n + 4, 9, np.uint8)
    kind[1:n + 1] = _CLASS[data]
    byte = np.zeros(n + 4, np.uint8)
    byte[1:n + 1] = data
    first = np.zeros(n + 4, bool)
    first[bounds[:-1] + 1] = True
    first[n + 1:] = True
    last = np.zeros(n, bool)
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    here, before, after = kind[1:n + 1], kind[:n], kind[2:n + 2]
    blank = here == 0
    start = first[1:n + 1] | (here != before)
    # a space goes with the word behind it
    start &= first[1:n + 1] | blank | (byte[:n] != 32)
    # the last white space before a word stands apart from those before it
    start |= blank & ~last & (after != 0)
    quote = np.flatnonzero((data == 39) & start & ~last)
    for tail in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        fits = np.ones(len(quote), bool)
        for i, c in enumerate(tail):
            fits &= (byte[quote + 2 + i] == c) & ~first[quote + 2 + i]
        found = quote[fits]
        start[found + 1] = False
        behind = found + 1 + len(tail)
        start[behind[behind < n]] = True
    return start


class _Encoder:
    """Ids of texts as little-endian bytes.

    The byte-level scheme cuts a text into words before it merges anything, so every distinct
    word is encoded once and remembered, in bounded number.  Files of any other kind are
    encoded text by text.
    """

    def __init__(self, encoding: Encoding):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(encoding.file)
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens", [])
        self.marks = [t["content"] for t in added]
        self.by_word = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and made.get("normalizer") is None and (made.get("model") or {}).get("type") == "BPE")
        largest = max(encoding.end_id, *self.tokenizer.get_vocab().values())
        self.kind, self.dtype = ("H", np.dtype("<u2")) if largest < 1 << 16 else ("I", np.dtype("<u4"))
        self.end = array(self.kind, [encoding.end_id]).tobytes()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        """Encode words that are not remembered."""
        if len(self.words) + len(new) > _CACHE_WORDS:
            self.older, self.words = self.words, {}
        known = {w: self.older[w] for w in new if w in self.older}
        missing = [w for w in new if w not in known]
        self.words.update(known)
        plain = [w for w in missing if self.by_word and _LETTERS.fullmatch(w)]
        # one word of letters: the model alone, which takes bytes by their visible characters
        model = self.tokenizer.model
        for w in plain:
            self.words[w] = array(self.kind, [t.id for t in model.tokenize(w.decode("latin-1").translate(_VISIBLE))]).tobytes()
        rest = [w for w in missing if w not in self.words]
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in rest], add_special_tokens=False)
        self.words.update(zip(rest, [array(self.kind, e.ids).tobytes() for e in found], strict=True))

    def _round(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text: cut into pieces, every distinct piece looked up once."""
        fine: list[bool] = []
        cut: list[bytes] = []
        ends: list[np.ndarray] = []
        bodies, at = [], 0
        for t in texts:
            body = t.encode("utf-8", "surrogatepass")
            whole = not self.by_word or _UNSURE.search(t) is not None or any(m in t for m in self.marks)
            plain = not whole and _NOT_FINE.search(t) is None
            fine.append(plain)
            if not plain and body:
                pieces = [body] if whole else [w.encode("utf-8", "surrogatepass") for w in _COARSE.findall(t)]
                cut.append(np.cumsum([len(w) for w in pieces[:-1]], dtype=np.int64) + at)
            bodies.append(body)
            at += len(body)
            ends.append(at)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        bounds = np.concatenate([[0], np.array(ends, np.int64)])
        starts = piece_starts(data, bounds)
        if not all(fine):
            # inside the other texts only the coarse cuts hold
            inside = np.repeat(np.array(fine), np.diff(bounds))
            starts &= inside
            for c in cut:
                starts[c] = True
        begins = bounds[:-1][np.diff(bounds) > 0]
        starts[begins] = True
        offsets = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)  # strings are shorter than 2 GB
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        _, places, body = coded.dictionary.buffers()
        edges = np.frombuffer(places, np.int32)[:len(coded.dictionary) + 1].tolist()
        body = body.to_pybytes() if body is not None else b""
        distinct = [body[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self._learn([w for w in distinct if w not in self.words])
        again = [w for w in distinct if w not in self.words]  # the memory was changed over
        if again:
            self._learn(again)
        ids = [self.words[w] for w in distinct]
        for w in distinct:
            if len(w) > 256:
                del self.words[w]
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        firsts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), self.dtype)
        codes = coded.indices.to_numpy()
        lengths = sizes[codes]
        total = np.cumsum(lengths)
        out = flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(firsts[codes] - (total - lengths), lengths)]
        # ids before each text: those of the pieces that start before it
        total = np.concatenate([[0], total])[np.searchsorted(offsets[:-1], bounds)]
        for a, b in zip(total[:-1], total[1:], strict=True):
            yield out[a:b].tobytes() + self.end

    def documents(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text and the end id."""
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= _ROUND_BYTES:
                yield from self._round(held)
                held, size = [], 0
        if held:
            yield from self._round(held)


@lru_cache(maxsize=2)
def _encoder(encoding: Encoding) -> _Encoder:
    """One per worker: the tasks of a worker share its words."""
    return _Encoder(encoding)


def _shard(body: list[bytes], entries: list[tuple[int, int, int]], width: int) -> bytes:
    data = b"".join(body)
    footer = np.array([(len(data) // width, len(entries), width)], FOOTER)
    return data + np.array(entries, ENTRY).tobytes() + footer.tobytes()


def write_dataset(docs: DataFrame, path: str, encoding: Encoding, shard_ids: int = 1 << 22) -> None:
    """Encode every row (doc_id, text; other columns are ignored) and write the dataset.

    Null and empty texts are the end id alone.  Null doc_ids come last.  Equal doc_ids are
    ordered by their texts' hash, then text, and each is a copy of its own; so rerunning gives the
    same ids in the same order.  An empty table makes a dataset without documents.  A shard
    takes documents until it holds ``shard_ids`` ids; a longer document is a shard's last.
    """
    spark = docs.sparkSession
    _write_shards(docs, f"{path}/shards", encoding, shard_ids)
    _directory(_shards(spark, path)).write.parquet(f"{path}/directory")
    _index(spark, path).write.parquet(f"{path}/index")


def _write_shards(docs: DataFrame, target: str, encoding: Encoding, shard_ids: int) -> None:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about four bytes an id; the null and repeated ids of a hot key are dealt by their texts
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (4 * shard_ids) + 1)
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(encoding)
        width = encoder.dtype.itemsize
        body: list[bytes] = []
        entries: list[tuple[int, int, int]] = []
        held = 0
        for b in batches:
            texts = (t.as_py() for t in b["text"])  # one at a time: a batch of texts may be large
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder.documents(texts), strict=True):
                body.append(ids)
                entries.append((doc_id or 0, len(ids) // width, int(doc_id is None)))
                held += len(ids) // width
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([_shard(body, entries, width)], pa.binary())})
                    body, entries, held = [], [], 0
        if entries:
            yield pa.RecordBatch.from_pydict({"value": pa.array([_shard(body, entries, width)], pa.binary())})

    # the text writer puts bytes down as they are; the mark at the end of a file is its line separator
    out = dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(target)


def _shards(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """(shard, file, content) of all shards or of the named files."""
    where = f"{path}/shards" if files is None else [f"{path}/shards/{f}" for f in files]
    read = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(where)
    file = F.element_at(F.split("path", "/"), -1)
    task, number = F.regexp_extract(file, r"^part-(\d+)-", 1).cast("bigint"), F.regexp_extract(file, r"-c(\d+)\.", 1).cast("bigint")
    return read.select((F.shiftleft(task, _FILE_BITS) + number).alias("shard"), file.alias("file"), "content")


def _parsed(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and entries of a shard; a damaged file fails."""
    data = memoryview(content)
    if bytes(data[-len(MAGIC):]) != MAGIC.encode():
        raise ValueError("not a whole shard")
    data = data[:-len(MAGIC)]
    footer = np.frombuffer(data[-FOOTER.itemsize:], FOOTER)[0]
    n_ids, n_docs, width = int(footer["n_ids"]), int(footer["n_docs"]), int(footer["width"])
    if n_ids * width + n_docs * ENTRY.itemsize + FOOTER.itemsize != len(data):
        raise ValueError("damaged shard")
    entries = np.frombuffer(data[n_ids * width:], ENTRY, n_docs)
    if int(entries["n"].sum(dtype=np.int64)) != n_ids:
        raise ValueError("damaged shard")
    return np.frombuffer(data, "<u2" if width == 2 else "<u4", n_ids), entries


def _directory(shards: DataFrame) -> DataFrame:
    """shard, file, n_ids, n_docs, base (ids before it), copies_before (of its first doc_id)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for shard, file, content in zip(b["shard"].to_pylist(), b["file"].to_pylist(), b["content"], strict=True):
                _, e = _parsed(content.as_py())
                first = (e["doc_id"] == e["doc_id"][0]) & (e["flags"] == e["flags"][0])
                last = (e["doc_id"] == e["doc_id"][-1]) & (e["flags"] == e["flags"][-1])
                ends = [(int(e["doc_id"][0]), int(e["flags"][0]), int(first.sum()))]
                if not first.all():
                    ends.append((int(e["doc_id"][-1]), int(e["flags"][-1]), int(last.sum())))
                for i, (doc_id, flags, n) in enumerate(ends):
                    rows.append((shard, file, int(e["n"].sum(dtype=np.int64)), len(e), i, doc_id, flags, n))
            names = ["shard", "file", "n_ids", "n_docs", "place", "doc_id", "flags", "rows"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    ends = shards.mapInArrow(describe, "shard bigint, file string, n_ids bigint, n_docs bigint, place int, doc_id bigint, flags int, rows bigint")
    earlier = Window.partitionBy("doc_id", "flags").orderBy("shard", "place").rowsBetween(Window.unboundedPreceding, -1)
    told = ends.withColumn("copies_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).where("place = 0")
    told = running_total(told, [], ["shard"], F.shiftright("shard", _FILE_BITS + 6), F.col("n_ids"), "base", inclusive=False)
    return told.select("shard", "file", "n_ids", "n_docs", "base", "copies_before")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "copy"), parts)


def _key_hashes(doc_id: np.ndarray, null: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits that tell any two keys apart."""
    return mixed(doc_id.astype(np.int64).view(np.uint64) ^ _GOLD), mixed(copy.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64) + _GOLD)


def _slots(h1: np.ndarray, h2: np.ndarray, pilot: np.ndarray, m: int) -> np.ndarray:
    return (mixed(h1 ^ mixed(h2 + pilot.astype(np.uint64) * _GOLD)) % np.uint64(m)).astype(np.int64)


def _bucket_of(h1: np.ndarray, h2: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(h1 + np.uint64(3) * h2) % np.uint64(buckets)).astype(np.int64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mixed(h1 * np.uint64(5) + h2) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of all buckets, and each key's slot; keys must be distinct.

    A pilot of 0 or more displaces the bucket's hashes; -1 - s names slot s.  Larger buckets
    are placed first, while most slots are free.
    """
    m = len(h1)
    buckets = max(1, -(-m // BUCKET_KEYS))
    where = _bucket_of(h1, h2, buckets)
    order = np.argsort(where, kind="stable")
    counts = np.bincount(where, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(counts)])
    pilots = np.zeros(buckets, np.int32)
    slots = np.zeros(m, np.int64)
    taken = np.zeros(m, bool)
    for b in np.argsort(-counts, kind="stable"):
        keys = order[starts[b]:starts[b + 1]]
        if len(keys) < 2:
            break
        tried, step = 0, 16
        while True:
            pilot = np.arange(tried, tried + step)
            at = _slots(h1[keys][None, :], h2[keys][None, :], pilot[:, None], m)
            fits = ~taken[at].any(axis=1)
            fits[fits] = (np.diff(np.sort(at[fits], axis=1), axis=1) > 0).all(axis=1)
            if fits.any():
                won = int(np.argmax(fits))
                pilots[b], slots[keys] = tried + won, at[won]
                taken[at[won]] = True
                break
            tried, step = tried + step, min(4096, step * 2)
    alone = order[starts[:-1][counts == 1]]
    slots[alone] = np.flatnonzero(~taken)[:len(alone)]
    pilots[where[alone]] = -1 - slots[alone]
    return pilots, slots


def _index(spark: SparkSession, path: str) -> DataFrame:
    """parts, part, pilots, slots: the index of all entries."""
    directory = spark.read.parquet(f"{path}/directory")
    known = directory.agg(F.sum("n_docs")).first()[0] or 0
    parts = max(1, -(-known // PART_KEYS))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b["shard"].to_pylist(), b["content"], strict=True):
                _, e = _parsed(content.as_py())
                new = np.ones(len(e), bool)
                new[1:] = (e["doc_id"][1:] != e["doc_id"][:-1]) | (e["flags"][1:] != e["flags"][:-1])
                runs = np.flatnonzero(new)
                ends = np.cumsum(e["n"].astype(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(len(e), shard, np.int64)), "doc_id": pa.array(e["doc_id"].astype(np.int64), mask=e["flags"] == 1),
                    "run": pa.array(np.cumsum(new)), "copy": pa.array(np.arange(len(e)) - runs[np.cumsum(new) - 1]),
                    "offset": pa.array(ends - e["n"]), "n": pa.array(e["n"].astype(np.int64)),
                })

    def build(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].combine_chunks()
        h1, h2 = _key_hashes(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), group["copy"].to_numpy())
        pilots, slots = perfect_hash(h1, h2)
        table = np.zeros(len(h1), SLOT)
        table["fingerprint"][slots] = _fingerprint(h1, h2)
        for c in ("n", "shard", "offset"):
            table[c][slots] = group[c].to_numpy()
        return pa.table({
            "parts": pa.array([parts], pa.int64()), "part": group["part"].slice(0, 1).combine_chunks().cast(pa.int64()),
            "pilots": pa.array([pilots.astype("<i4").tobytes()], pa.binary()), "slots": pa.array([table.tobytes()], pa.binary()),
        })

    found = _shards(spark, path).select("shard", "content").mapInArrow(entries, "shard bigint, doc_id bigint, run bigint, copy bigint, offset bigint, n bigint")
    found = found.join(directory.select("shard", "copies_before"), "shard")
    found = found.withColumn("copy", F.col("copy") + F.when(F.col("run") == 1, F.col("copies_before")).otherwise(0))
    keyed = found.select(_part(F.lit(parts)).alias("part"), "doc_id", "copy", "shard", "offset", "n")
    return keyed.groupBy("part").applyInArrow(build, "parts bigint, part bigint, pilots binary, slots binary")


def _probe(pilots: bytes, slots: bytes, ids: pa.Array, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys have a slot with their fingerprint, those slots)."""
    pilot, table = np.frombuffer(pilots, "<i4"), np.frombuffer(slots, SLOT)
    h1, h2 = _key_hashes(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), copy)
    p = pilot[_bucket_of(h1, h2, len(pilot))]
    at = np.where(p < 0, -1 - p.astype(np.int64), _slots(h1, h2, np.maximum(p, 0), len(table)))
    hit = table["fingerprint"][at] == _fingerprint(h1, h2)
    return np.flatnonzero(hit), table[at[hit]]


_PLACES = "doc_id bigint, copy bigint, shard bigint, offset bigint, n_tokens bigint"


def _located(index: DataFrame, keys: DataFrame) -> DataFrame:
    first = index.select("parts").first()
    if first is None:
        return index.sparkSession.createDataFrame([], _PLACES)
    asked = keys.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("copy").cast("bigint").alias("copy")).distinct()
    asked = asked.withColumn("part", _part(F.lit(first[0])))

    def probe(keys: pa.Table, part: pa.Table) -> pa.Table:
        if not part.num_rows or not keys.num_rows:
            hits, rows = np.zeros(0, np.int64), np.zeros(0, SLOT)
        else:
            ids = keys["doc_id"].combine_chunks()
            hits, rows = _probe(part["pilots"][0].as_py(), part["slots"][0].as_py(), ids, keys["copy"].to_numpy())
        taken = keys.select(["doc_id", "copy"]).take(pa.array(hits))
        told = [pa.array(rows[c].astype(np.int64)) for c in ("shard", "offset", "n")]
        return pa.table([*taken.columns, *told], names=["doc_id", "copy", "shard", "offset", "n_tokens"])

    return asked.groupBy("part").cogroup(index.select("part", "pilots", "slots").groupBy("part")).applyInArrow(probe, _PLACES)


def _fetched(shards: DataFrame, places: DataFrame) -> DataFrame:
    """Adds ``ids`` (little-endian, 4 bytes each) from the shards' bytes; keys of other documents go."""

    def cut_out(places: pa.Table, shard: pa.Table) -> pa.Table:
        kept: list[int] = []
        out: list[bytes] = []
        if places.num_rows and shard.num_rows:
            ids, entries = _parsed(shard["content"][0].as_py())
            starts = np.cumsum(entries["n"].astype(np.int64)) - entries["n"]
            asked, null = places["doc_id"].combine_chunks(), places["doc_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
            offset, n = places["offset"].to_numpy(), places["n_tokens"].to_numpy()
            at = np.minimum(np.searchsorted(starts, offset), len(starts) - 1)
            same = (starts[at] == offset) & (entries["n"][at] == n) & (entries["doc_id"][at] == asked.fill_null(0).to_numpy()) & ((entries["flags"][at] == 1) == null)
            kept = np.flatnonzero(same).tolist()
            out = [ids[offset[i]:offset[i] + n[i]].astype("<u4").tobytes() for i in kept]
        return places.take(pa.array(kept, pa.int64())).append_column("ids", pa.array(out, pa.binary()))

    return places.groupBy("shard").cogroup(shards.select("shard", "content").groupBy("shard")).applyInArrow(cut_out, f"{_PLACES}, ids binary")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Documents of the keys (doc_id, copy): doc_id, copy, shard, offset, start (ids of all
    documents before it), n_tokens and ids (binary, 4 little-endian bytes each).

    Keys without a document give no row; a key asked for twice gives one.
    """
    places = _located(spark.read.parquet(f"{path}/index"), keys)
    starts = spark.read.parquet(f"{path}/directory").select("shard", "base")
    told = _fetched(_shards(spark, path), places).join(starts, "shard")
    return told.select("doc_id", "copy", "shard", "offset", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``lookup`` of a short list of ids (their first copies) that opens only the parts of the
    index and the files that hold them."""
    index = spark.read.parquet(f"{path}/index")
    keys = spark.createDataFrame([(d, 0) for d in doc_ids], "doc_id bigint, copy bigint")
    parts = (index.select("parts").first() or [1])[0]
    needed = [r[0] for r in keys.select(_part(F.lit(parts))).distinct().collect()]
    places = _located(index.where(F.col("part").isin(needed)), keys).toArrow()
    wanted = sorted(set(places["shard"].to_pylist()))
    directory = spark.read.parquet(f"{path}/directory").where(F.col("shard").isin(wanted)).select("shard", "file", "base")
    files = [r["file"] for r in directory.collect()]
    if not files:
        return spark.createDataFrame([], "doc_id bigint, copy bigint, shard bigint, offset bigint, start bigint, n_tokens bigint, ids binary")
    told = _fetched(_shards(spark, path, files), spark.createDataFrame(places)).join(directory.select("shard", "base"), "shard")
    return told.select("doc_id", "copy", "shard", "offset", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, copy) of all rows.  The copies of one id are counted before any shuffle and
    counted out in runs, so that an id of very many rows is no single task's work."""
    counted = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("rows"))
    run = 1 << 16
    runs = counted.select("doc_id", "rows", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(run))).alias("at"))
    runs = runs.repartition("doc_id", "at")
    return runs.select("doc_id", F.explode(F.sequence("at", F.least(F.col("at") + run, "rows") - 1)).alias("copy"))
