"""Quality score by a factorisation machine.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over hashed words,
structure statistics of the text and the length that the table states.  The pairwise sum
costs linear time: it is half of sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2].
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import fold_of
from tripwise.llm.learning import buckets, collect_features, encoded, labelled_sample, plain_words

#: Parameters: bound of the training sample, word buckets, bins per statistic, factors.
TRAIN_ROWS = 12_000
BITS = 14
BINS = 12
FACTORS = 8
STATISTICS = 10

_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,")
_HIGH = bytes(range(128, 256))


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values: words with counts damped and scaled to length 1, and one bin
    per statistic.  An empty or null text has statistics only."""
    data = encoded(text)
    words = plain_words(data)
    ids, counts = np.unique(buckets(words, BITS), return_counts=True)
    vals = np.log1p(counts.astype(np.float64))
    if len(vals):
        vals /= np.sqrt((vals * vals).sum())
    size = max(1, len(data))
    share = lambda kind: (size - len(data.translate(None, kind)) - (size - len(data))) / size
    lines = data.split(b"\n")
    bins = (
        np.log2(1 + len(words)) * 0.8, (sum(map(len, words)) / max(1, len(words))), 12 * len(set(words)) / max(1, len(words)),
        30 * share(_CAPITALS), 30 * share(_DIGITS), 30 * share(_SYMBOLS), 12 * share(_HIGH), 12 * (1 - len(set(lines)) / len(lines)),
        np.log2(1 + len(words) / len(lines)), BINS - 1 if n_chars is None else np.log2(1 + max(0, n_chars)) * 0.65,
    )
    at = (1 << BITS) + np.array([i * BINS + min(BINS - 1, int(b)) for i, b in enumerate(bins)], dtype=np.int64)
    return np.concatenate([ids, at]), np.concatenate([vals, np.full(STATISTICS, 0.5)])


@dataclass(frozen=True)
class FactorisationMachine:
    """Bias, linear weights (D), factors (D x k)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, ids: np.ndarray, vals: np.ndarray) -> float:
        scaled = self.factors[ids] * vals[:, None]
        pairs = 0.5 * float((scaled.sum(axis=0) ** 2 - (scaled**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.linear[ids] @ vals) + pairs, -40, 40))))


def fit(labels: np.ndarray, ids: list[np.ndarray], vals: list[np.ndarray], epochs: int = 8, rate: float = 0.08, decay: float = 2e-5, seed: int = 3) -> FactorisationMachine:
    """AdaGrad on the log loss in batches of 64; deterministic."""
    width = (1 << BITS) + STATISTICS * BINS
    draw = np.random.default_rng(seed)
    w, v = np.zeros(width), draw.normal(0, 0.03, (width, FACTORS))
    if not len(labels):
        return FactorisationMachine(0.0, w.astype(np.float32), np.zeros((width, FACTORS), np.float32))
    y = (labels == 1).astype(np.float64)
    mean = np.clip(y.mean(), 0.01, 0.99)
    b = float(np.log(mean / (1 - mean)))
    gw, gv = np.full(width, 1e-3), np.full((width, FACTORS), 1e-3)
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(y), 64):
            part = order[at:at + 64]
            i, x = np.concatenate([ids[r] for r in part]), np.concatenate([vals[r] for r in part]).astype(np.float64)
            sizes = np.array([len(ids[r]) for r in part])
            starts, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(part)), sizes)
            scaled = v[i] * x[:, None]
            total = np.add.reduceat(scaled, starts, axis=0)
            z = b + np.add.reduceat(w[i] * x, starts) + 0.5 * (total**2 - np.add.reduceat(scaled**2, starts, axis=0)).sum(axis=1)
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            ex = e[of] * x
            uniq, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, ex, len(uniq)) + decay * w[uniq]
            dv = np.stack([np.bincount(back, ex * (total[of, f] - scaled[:, f]), len(uniq)) for f in range(FACTORS)], axis=1) + decay * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v[uniq] -= rate * 0.3 * dv / np.sqrt(gv[uniq])
            b -= rate * float(e.sum())
    return FactorisationMachine(b, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    return fit(*collect_features(labelled_sample(docs, labels, "quality", rows), features))


def quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    held_out: crc32 of the id as text modulo 3 is 1 (false for a null id); such labels are
    never learned from.  score: chance of label 1 from the text and n_chars alone; empty and
    null texts have one too.  Without any labels every score is 0.5.
    """
    model = train(docs, labels, rows)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(*features(t, n)) for t, n in zip(b["text"].to_pylist(), b["n_chars"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("n_chars").cast("bigint").alias("n_chars")).mapInArrow(rows_of, "doc_id bigint, score double")
    return scored.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
