"""What the trained operators share: words of a text, bounded training samples."""

from __future__ import annotations

import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import fold_of

#: ASCII letters to small ones, digits kept, all other ASCII to spaces; one pass over the bytes.
_FOLD = bytes(
    ord(chr(i).lower()) if i < 128 and chr(i) in string.ascii_letters else i if i >= 128 or chr(i) in string.digits else 32 for i in range(256)
)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return data.translate(_FOLD).split()


def buckets(words: list[bytes], bits: int) -> np.ndarray:
    """Hash bucket of each word."""
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) & ((1 << bits) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 3, held: int = 1, seed: int = 7) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, with column ``_label``.

    The draw takes the labels of smallest hash, so it does not depend on partitioning; its
    bound makes it small enough to send to every executor, and only its texts are read.
    Null labels and null ids are left out; a label given twice counts once.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where("_label is not null and doc_id is not null").distinct()
    known = known.where(fold_of(F.col("doc_id"), folds) != held)
    drawn = known.orderBy(F.xxhash64(F.lit(seed), "doc_id", "_label"), "doc_id", "_label").limit(rows)
    return docs.select("doc_id", "text", "n_chars").join(F.broadcast(drawn), "doc_id")


def collect_features(sample: DataFrame, encode: Callable[[str | None, int | None], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Labels, feature ids and values of a bounded sample, in an order of their own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [encode(t, n) for t, n in zip(b["text"].to_pylist(), b["n_chars"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b["doc_id"], b["_label"], pa.array([i.astype(np.int32).tobytes() for i, _ in out], pa.binary()),
                pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary()),
            ], names=["doc_id", "label", "ids", "vals"])

    got = sample.mapInArrow(rows, "doc_id bigint, label int, ids binary, vals binary").toArrow()
    data = sorted(zip(*[got[c].to_pylist() for c in ("doc_id", "label", "ids", "vals")], strict=True))
    labels = np.array([r[1] for r in data], dtype=np.int64)
    return labels, [np.frombuffer(r[2], np.int32) for r in data], [np.frombuffer(r[3], np.float32) for r in data]
