"""Quality by ordinal cumulative-link regression on graded ratings (operator 4).

One weight vector over hashed text features is shared by all grades; ordered thresholds cut
its score: P(grade <= g_k) = 1 / (1 + exp(score - threshold_k)). Features are n-grams of a
text's shape (letters, capitals, digits, blanks, each mark) and marks of repetition, hashed
into ``BUCKETS``. Fitting uses a sample of rated rows of at most ``SAMPLE``; scoring reads whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm.common import lower_words, steps, text_bytes

BUCKETS = 1024
#: Rated rows that the model is fitted on at most, taken in the order of a hash of their id.
SAMPLE = 6_000
#: Least probability of the best grade with which the filter keeps a row.
KEEP_FROM = 0.5
ROUNDS, RATE, PENALTY = 400, 0.05, 1e-4

#: Class of each byte: 0 small letters and other scripts, 1 capitals, 2 digits, 3 blank, 4 line break, 5 control, then one for each mark.
_SHAPE = np.array(
    [
        4 if c in (10, 13) else 3 if c in (9, 11, 12, 32) else 5 if c < 32 or c == 127 else 2 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 0 if 97 <= c <= 122 or c > 127 else c
        for c in range(256)
    ],
    np.uint64,
)


def _hashed(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def features(text: bytes) -> np.ndarray:
    """The hashed features of a text; an empty text has only its marks."""
    out = np.zeros(BUCKETS)
    shape = _SHAPE[np.frombuffer(text, np.uint8)]
    if len(shape):
        # Runs of letters, digits and blanks count once, runs of marks as they are.
        shape = shape[np.concatenate(([True], (shape[1:] != shape[:-1]) | (shape[1:] > 4)))]
        for n in (2, 4):
            if len(shape) >= n:
                codes = np.full(len(shape) - n + 1, n, np.uint64)
                for k in range(n):
                    codes = (codes << np.uint64(7)) | shape[k : len(shape) - n + 1 + k]
                found = np.sqrt(np.bincount(_hashed(codes), minlength=BUCKETS))
                out += found / max(np.linalg.norm(found), 1e-9)
    words = lower_words(text)
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words[1:], words[:-1]))
    pairs = len(set(zip(words[1:], words[:-1])))
    marks = (
        b"length %d" % n.bit_length(),
        b"different %d" % (10 * len(set(words)) // max(n, 1)) + b" of %d" % (n.bit_length() // 2),
        b"in a row %d" % min(10, 20 * repeated // max(n, 1)),
        b"pairs %d" % (10 * pairs // max(n - 1, 1)),
        b"lines %d" % (10 * len(set(lines)) // max(len(lines), 1)),
    )
    for mark in marks:
        out[zlib.crc32(mark) % BUCKETS] += 0.5
    return out


@dataclass
class OrdinalModel:
    """Grades in order, the shared weights and the thresholds between the grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def upper(self, x: np.ndarray) -> np.ndarray:
        """P(grade > g_k) for each row and each grade but the last."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -40, 40)))

    def expected(self, x: np.ndarray) -> np.ndarray:
        steps_ = np.diff(np.asarray(self.grades, float))
        return self.grades[0] + self.upper(x) @ steps_

    def tail(self, x: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= ``grade``)."""
        k = int(np.searchsorted(self.grades, grade))
        if k == 0 or k == len(self.grades):
            return np.full(len(x), float(k == 0))
        return self.upper(x)[:, k - 1]


def fit_ordinal(x: np.ndarray, y: np.ndarray) -> OrdinalModel | None:
    """Most likely weights and thresholds with a small ridge, by Adam on all rows; None without rows.

    One grade alone gives a model that always expects it.
    """
    grades = sorted({int(g) for g in y})
    if not grades:
        return None
    k = np.searchsorted(grades, y)
    m = len(grades) - 1
    if not m:
        return OrdinalModel(grades, np.zeros(x.shape[1]), np.zeros(0))
    shares = np.clip([(k <= i).mean() for i in range(m)], 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    # The thresholds are the first and the logarithms of the steps, so they stay in order.
    p = np.concatenate((np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    d = x.shape[1]
    mean, square = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(len(k))
    for t in range(1, ROUNDS + 1):
        gaps = np.exp(np.clip(p[d + 1 :], -20, 20))
        cuts = p[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        s = 1 / (1 + np.exp(-np.clip(cuts[None, :] - (x @ p[:d])[:, None], -40, 40)))
        cum = np.concatenate((np.zeros((len(k), 1)), s, np.ones((len(k), 1))), axis=1)
        slope = cum * (1 - cum)
        likely = np.maximum(cum[rows, k + 1] - cum[rows, k], 1e-12)
        high, low = slope[rows, k + 1] / likely, slope[rows, k] / likely
        by_cut = np.array([low[k == i + 1].sum() - high[k == i].sum() for i in range(m)]) / len(k)
        grad = np.concatenate((x.T @ (high - low) / len(k) + PENALTY * p[:d], [by_cut.sum()], [by_cut[i + 1 :].sum() * gaps[i] for i in range(m - 1)]))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        p = p - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(np.clip(p[d + 1 :], -20, 20))
    return OrdinalModel(grades, p[:d], p[d] + np.concatenate(([0.0], np.cumsum(gaps))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        found = [features(t).astype("<f4").tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["grade"], pa.array(found, pa.binary())], ["grade", "found"])


def fit(docs: DataFrame, ratings: DataFrame, rows: int = SAMPLE, grade: str = "quality") -> OrdinalModel | None:
    """A model from at most ``rows`` rated documents.

    ``ratings`` has doc_id and ``grade``; the highest of several grades of an id counts, rows with a null in
    either do not. None if no rated document exists.
    """
    rated = ratings.select(col("doc_id").cast("long").alias("rated_id"), col(grade).cast("int").alias("grade")).dropna()
    rated = rated.groupBy("rated_id").agg(F.max("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(rows)
    texts = docs.select(col("doc_id").cast("long").alias("rated_id"), text_bytes().alias("text")).join(F.broadcast(sample), "rated_id")
    found = texts.select("grade", "text", F.xxhash64("rated_id").alias("at")).mapInArrow(_features, "grade int, found binary").limit(rows).collect()
    if not found:
        return None
    x = np.stack([np.frombuffer(r["found"], "<f4") for r in found]).astype(float)
    return fit_ordinal(x, np.array([r["grade"] for r in found]))


def _scorer(model: OrdinalModel, grade: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, batch_text):
            x = np.stack([features(t) for t in batch[batch_text].to_pylist()])
            arrays = [c for n, c in zip(batch.schema.names, batch.columns) if n != batch_text]
            names = [n for n in batch.schema.names if n != batch_text]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.expected(x)), pa.array(model.tail(x, grade))], [*names, "expected_grade", "tail"])

    batch_text = "scored_text"
    return score


def score(docs: DataFrame, model: OrdinalModel | None, grade: int | None = None) -> DataFrame:
    """doc_id, expected_grade and tail (the probability of ``grade``, the best one if None, or better) of every row.

    Null texts count as empty. Without a model both are null.
    """
    base = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("scored_text"))
    if model is None:
        nothing = F.lit(None).cast("double")
        return base.select("doc_id", nothing.alias("expected_grade"), nothing.alias("tail"))
    grade = model.grades[-1] if grade is None else grade
    return base.mapInArrow(_scorer(model, grade), "doc_id long, expected_grade double, tail double")


def keep_good(docs: DataFrame, model: OrdinalModel | None, least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose best grade has at least the probability ``least``; all without a model."""
    if model is None:
        return docs
    kept = [f"c{i}" for i in range(len(docs.columns))]
    base = docs.select(*(col(c).alias(k) for k, c in zip(kept, docs.columns)), text_bytes().alias("scored_text"))
    schema = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, docs.schema.fields))
    scored = base.mapInArrow(_scorer(model, model.grades[-1]), f"{schema}, expected_grade double, tail double")
    return scored.where(F.col("tail") >= least).select(*(F.col(k).alias(c) for k, c in zip(kept, docs.columns)))
