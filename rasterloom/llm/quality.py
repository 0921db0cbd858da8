"""Quality classifier: ordinal cumulative-link regression on hashed words.

P(grade <= k) = sigmoid(threshold_k - score(text)) with ordered thresholds and
one shared weight for each hashed word, so a text gets its expected grade and
the probability of reaching the top grade.  It is fitted on the driver on at
most TRAIN_ROWS graded documents (a bounded sample by hash of doc_id; the bound
is a parameter), of which only hashed word counts are sent.  Prediction covers
every row and whole texts.

op6 rates each labelled document 0 (bad), 1 (good but toxic) or 2 (good), so two
thresholds are fitted.

Null and wordless texts are scored by one weight of their own.  Null grades take
no part in training; without graded rows the expected grade and tail are null.
A document with several grades counts with each; repeated rows each give a row.
Very long texts are read whole.  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, table, text_chunks

BUCKETS, TRAIN_ROWS, SELECTED = 1 << 15, 6_000, 0.4
_EXTRA = 4  # features behind the word buckets: no words, and three of shape
_CHUNK = 1 << 20


class WordHash(dict):
    """Word to bucket, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = zlib.crc32(word) % BUCKETS
        return out


def features(text: bytes, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text: square roots of word frequencies (unit length) and shape features."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.array([BUCKETS]), np.array([1.0])
    bins, counts = np.unique(np.fromiter(map(hashes.__getitem__, words), np.int64, n), return_counts=True)
    raw = np.frombuffer(text, np.uint8)
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    upper = ((raw >= 65) & (raw <= 90)).mean()
    odd = (~letters & (raw > 32)).mean()
    repeats = 1 - len(bins) / n
    return np.concatenate((bins, np.arange(BUCKETS + 1, BUCKETS + _EXTRA))), np.concatenate((np.sqrt(counts / n), [upper * 4, odd * 4, repeats]))


class OrdinalModel:
    """Weights and ordered thresholds for sorted grades."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def predict(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the highest grade) of each score."""
        below = 1 / (1 + np.exp(-(self.thresholds[None, :] - scores[:, None])))
        steps = np.diff(below, axis=1, prepend=0, append=1)
        return steps @ np.array(self.grades, float), steps[:, -1]


def fit(columns: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, epochs: int = 60, l2: float = 1e-4) -> OrdinalModel | None:
    """Fit by gradient descent with per-weight step sizes (AdaGrad) on the full sample."""
    names = sorted(set(grades.tolist()))
    if not names:
        return None
    y = np.searchsorted(names, grades)
    k = len(names) - 1
    weights = np.zeros(BUCKETS + _EXTRA)
    cuts = np.array([np.log((np.mean(y <= i) + 1e-3) / (1 - np.mean(y <= i) + 1e-3)) for i in range(k)])
    if not k:
        return OrdinalModel(names, weights, cuts)
    rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    cols, vals = np.concatenate(columns), np.concatenate(values)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    gw2, gc2 = np.full(len(weights), 1e-8), np.full(k, 1e-8)
    for _ in range(epochs):
        s = np.bincount(rows, weights[cols] * vals, minlength=len(y))
        upper = np.where(y < k, sig(np.append(cuts, np.inf)[y] - s), 1.0)
        lower = np.where(y > 0, sig(np.append(-np.inf, cuts)[y] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gs = (du - dl) / len(y)  # gradient of the loss by the score
        gw = np.bincount(cols, gs[rows] * vals, minlength=len(weights)) + l2 * weights / len(y)
        gc = np.array([(-(du * (y == i)) + dl * (y == i + 1)).sum() / len(y) for i in range(k)])
        gw2 += gw * gw
        gc2 += gc * gc
        weights -= 0.5 * gw / np.sqrt(gw2)
        cuts = np.sort(cuts - 0.1 * gc / np.sqrt(gc2))
    return OrdinalModel(names, weights, cuts)


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", rows: int = TRAIN_ROWS) -> OrdinalModel | None:
    graded = labels.where(F.col(grade_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(grade_col).cast("int").alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `rows` pairs of numbers
    schema = pa.schema([("grade", pa.int32()), ("cols", pa.list_(pa.int32())), ("vals", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            found = [features(t, hashes) for _, _, data in text_chunks(b.column(1), _CHUNK) for t in data]
            yield record_batch({"grade": b.column(0), "cols": [c.astype(np.int32) for c, _ in found], "vals": [v for _, v in found]}, schema)

    got = picked.select("grade", "text").mapInArrow(run, "grade int, cols array<int>, vals array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["grade"], r["cols"], r["vals"]))  # the same fit whatever the order of tasks
    return fit([np.array(r["cols"], np.int64) for r in got], [np.array(r["vals"]) for r in got], np.array([r["grade"] for r in got], np.int64))


OUT = "doc_id long, expected_grade double, tail_prob double, selected boolean"


def grade(docs: DataFrame, model: OrdinalModel | None, threshold: float = SELECTED) -> DataFrame:
    """doc_id, expected_grade, tail_prob (of the top grade) and selected (tail_prob >= threshold) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("selected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = shared.value, WordHash()
        for b in batches:
            if not b.num_rows:
                continue
            if model is None:
                none = [None] * b.num_rows
                yield record_batch({"doc_id": b.column(0), "expected_grade": none, "tail_prob": none, "selected": none}, schema)
                continue
            found = (features(t, hashes) for _, _, data in text_chunks(b.column(1), _CHUNK) for t in data)
            expected, tail = model.predict(np.array([model.weights[c] @ v for c, v in found]))
            yield record_batch({"doc_id": b.column(0), "expected_grade": expected, "tail_prob": tail, "selected": tail >= threshold}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rating = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return grade(docs, train(docs, labels.select("doc_id", rating.alias("rating")), "rating"))
