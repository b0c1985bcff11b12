"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, ordered
thresholds between them.  Labels only say toxic or not, so the grades of toxic training
documents are told apart by how much marked language they hold: words far more frequent in
toxic documents are found by a z-score, and toxic documents are split into equal thirds by
the number of such words.  x is log(1 + count) of hashed words and word beginnings that
differ between toxic and clean documents; all others have weight 0, so long documents
gather no noise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import fold_of
from tripwise.llm.learning import buckets, collect_features, encoded, labelled_sample, plain_words

#: Parameters: bound of the training sample, hash buckets, least |z| of a feature, grades.
TRAIN_ROWS = 12_000
BITS = 20
LEAST_Z = 6.0
#: Fewest toxic training documents that hold a feature.
LEAST_DOCS = 5
GRADES = 4
#: Bytes of word beginnings that are features beside the whole word.
STEMS = (5, 6, 7, 8)


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted buckets with their weights, which of them mark toxic texts, the weight that all
    marks share, ordered thresholds."""

    ids: np.ndarray
    weights: np.ndarray
    marked: np.ndarray
    common: float
    thresholds: np.ndarray

    def linear(self, text: str | None) -> float:
        hashed, counts = text_features(text)
        if not len(hashed) or not len(self.ids):
            return 0.0
        at = np.minimum(np.searchsorted(self.ids, hashed), len(self.ids) - 1)
        hit = self.ids[at] == hashed
        held = np.bincount(at[hit], counts[hit], minlength=len(self.ids))
        return float(np.log1p(held) @ self.weights + np.log1p(held @ self.marked) * self.common)

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade per score."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))
        upto = np.hstack([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))])
        return np.diff(upto, axis=1)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of words and word beginnings, with counts; a bucket may come repeatedly."""
    counted = Counter(plain_words(encoded(text)))
    words = list(counted)
    counts = np.fromiter(counted.values(), dtype=np.int64, count=len(words))
    ids, held = [buckets(words, BITS)], [counts]
    for n in STEMS:
        longer = [w[:n] for w in words if len(w) > n]
        # the length is part of the key: a stem is not the word of the same letters
        ids.append(np.fromiter((crc32(w, n) for w in longer), dtype=np.int64, count=len(longer)) & ((1 << BITS) - 1))
        held.append(counts[[len(w) > n for w in words]] if words else counts)
    return np.concatenate(ids), np.concatenate(held)


def _encode(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = text_features(text)
    uniq, back = np.unique(ids, return_inverse=True)
    return uniq, np.bincount(back, counts, len(uniq))


def fit(labels: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], steps: int = 600) -> OrdinalModel:
    """Fit by full-batch Adam on the penalised likelihood; deterministic."""
    toxic = labels == 1
    n1, n0 = toxic.sum(), (~toxic).sum()
    empty = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.0, np.array([2.0 + k for k in range(GRADES - 1)]))
    if not n1 or not n0:
        return empty
    size = 1 << BITS
    held1 = np.bincount(np.concatenate([i for i, t in zip(ids, toxic, strict=True) if t]), minlength=size)
    held0 = np.bincount(np.concatenate([i for i, t in zip(ids, toxic, strict=True) if not t]), minlength=size)
    p1, p0, p = (held1 + 0.5) / (n1 + 1), (held0 + 0.5) / (n0 + 1), (held1 + held0 + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    marked = (z >= LEAST_Z) & (held1 >= LEAST_DOCS)
    chosen = np.flatnonzero(marked | (z <= -LEAST_Z))
    if not len(chosen):
        return empty
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    rows, cols, vals, marks = [], [], [], np.zeros(len(labels))
    for r, (i, c) in enumerate(zip(ids, counts, strict=True)):
        keep = place[i] >= 0
        rows.append(np.full(keep.sum(), r)), cols.append(place[i[keep]]), vals.append(np.log1p(c[keep]))
        marks[r] = c[marked[i]].sum()
        rows.append([r]), cols.append([len(chosen)]), vals.append([np.log1p(marks[r])])
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    grade = np.zeros(len(labels), np.int64)
    cuts = np.quantile(marks[toxic], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grade[toxic] = 1 + np.searchsorted(cuts, marks[toxic], side="left")
    w, thresholds = _descend(rows, cols, vals, grade, len(chosen) + 1, steps)
    return OrdinalModel(chosen.astype(np.int64), w[:-1], marked[chosen].astype(np.float64), float(w[-1]), thresholds)


def _descend(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, width: int, steps: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss."""
    n = len(grade)
    w, a = np.zeros(width), np.zeros(GRADES - 1)
    a[0] = 2.0
    moments = [np.zeros(width + GRADES - 1), np.zeros(width + GRADES - 1)]

    def thresholds(a: np.ndarray) -> np.ndarray:
        return a[0] + np.concatenate([[0.0], np.cumsum(np.exp(a[1:]))])

    for step in range(1, steps + 1):
        s = np.bincount(rows, vals * w[cols], n)
        t = thresholds(a)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - s, -40, 40))), 1 / (1 + np.exp(-np.clip(edge[grade] - s, -40, 40)))
        hi, lo = np.where(grade == GRADES - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = (dhi - dlo) / n  # of the negative log likelihood
        dt = np.bincount(np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -dhi, 0.0), GRADES - 1)
        dt += np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, dlo, 0.0), GRADES - 1)
        dt /= n
        da = np.concatenate([[dt.sum()], np.exp(a[1:]) * np.cumsum(dt[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(cols, vals * ds[rows], width) + 2e-5 * w, da])
        for m, x, beta in ((moments[0], g, 0.9), (moments[1], g * g, 0.999)):
            m *= beta
            m += (1 - beta) * x
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[:width]
        a -= move[width:]
    return w, thresholds(a)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    return fit(*collect_features(labelled_sample(docs, labels, "toxic", rows), _encode))


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with _severity (expected grade, 0 to 3), _p_toxic (chance of a grade above 0)
    and _grade (the likeliest); null and empty texts hold no words and get the base rates.

    Only the text reaches Python; all other columns pass through unread.
    """
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(GRADES)
        for b in batches:
            p = model.grades(np.array([model.linear(t) for t in b["text"].to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in names], pa.array(p @ at, pa.float64()), pa.array(1 - p[:, 0], pa.float64()), pa.array(p.argmax(axis=1), pa.int32())],
                names=[*names, "_severity", "_p_toxic", "_grade"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("_severity", T.DoubleType()), T.StructField("_p_toxic", T.DoubleType()), T.StructField("_grade", T.IntegerType())])
    return docs.mapInArrow(rows, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, severity, p_toxic, grade, rejected.

    held_out: crc32 of the id as text modulo 3 is 1 (false for a null id); such labels are
    never learned from.  rejected: a grade above 0 is likelier than not.  Without labels of
    both kinds nothing is rejected.
    """
    graded = grade_documents(docs.select("doc_id", "text"), train(docs, labels, rows))
    return graded.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), F.col("_severity").alias("severity"),
        F.col("_p_toxic").alias("p_toxic"), F.col("_grade").alias("grade"), (F.col("_p_toxic") >= 0.5).alias("rejected"),
    )
