"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k): one weight vector for all grades and
ordered thresholds t_1 < ... < t_K. The features are hashed text: which words
a text holds, and the share of its words of each shape (first and last
characters' classes, length) or equal to the word before. The model is fitted
on the driver on a bounded sample of rated documents, sent along as one short
vector, and every document is scored whole where it lies; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.hashing import U, mix, span_hashes, word_spans
from tallyfold.llm.tables import bounded_batches, text_chunks, text_of

WORD_BITS, SHAPE_BITS = 13, 10
# Rated documents that the model is fitted on at most: those with the least
# hash of their id, so the sample is the same in every run.
MAX_RATED = 4000
# The grade from which a document counts as good, and the least probability of it.
GOOD_GRADE, CUT = 2, 0.5

_CLASS = np.arange(256)
_CLASS[[b for b in range(256) if b >= 128 or chr(b).islower()]] = 1
_CLASS[[b for b in range(128) if chr(b).isupper()]] = 2
_CLASS[[b for b in range(128) if chr(b).isdigit()]] = 3
_CLASS = _CLASS.astype(U)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), one of each row and feature."""
    start, end, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    hashes = span_hashes(data, start, end)
    counts = np.bincount(row, minlength=rows)
    word = np.unique(row * (1 << WORD_BITS) + (hashes >> U(64 - WORD_BITS)).astype(np.int64))
    inner = np.maximum(end - 1, start)
    shape = _CLASS[data[start]] << U(24) | _CLASS[data[end]] << U(16) | _CLASS[data[inner]] << U(8) | np.minimum(end - start, 20).astype(U)
    shape = (mix(shape + U(1)) >> U(64 - SHAPE_BITS)).astype(np.int64)
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    keys, n = np.unique(np.concatenate([row, row[again]]) * (1 << SHAPE_BITS) + np.concatenate([shape, np.zeros(again.sum(), np.int64)]), return_counts=True)
    shape_row = keys >> SHAPE_BITS
    return (
        np.concatenate([word >> WORD_BITS, shape_row]),
        np.concatenate([word & ((1 << WORD_BITS) - 1), (keys & ((1 << SHAPE_BITS) - 1)) + (1 << WORD_BITS)]),
        np.concatenate([np.full(len(word), 0.3), 10.0 * n / counts[shape_row]]),
    )


SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a column each."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature, value = features(data, offsets)
        return np.bincount(row, self.weights[feature] * value, minlength=len(offsets) - 1)


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, top: int, steps: int = 300, ridge: float = 2e-3) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam steps over all rows. The first
    threshold and the logarithms of the gaps are the free parameters, so the
    thresholds stay ordered."""
    n = len(grade)
    share = np.clip([(grade >= k).mean() for k in range(1, top + 1)], 0.01, 0.99)
    first = np.log(1 / share - 1)
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    theta = np.concatenate([np.zeros(SIZE), first[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    level = np.arange(n)

    def thresholds() -> np.ndarray:
        return theta[SIZE] + np.concatenate([[0.0], np.cumsum(np.exp(theta[SIZE + 1 :]))])

    for step in range(1, steps + 1):
        t = thresholds()
        scores = np.bincount(row, theta[feature] * value, minlength=n)
        tail = np.concatenate([np.ones((n, 1)), _sigmoid(scores[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        slope = tail * (1 - tail)
        p = np.maximum(tail[level, grade] - tail[level, grade + 1], 1e-9)
        low, high = slope[level, grade] / p, slope[level, grade + 1] / p
        # Gradients of the mean negative log likelihood.
        by_score = -(low - high) / n
        by_t = np.array([(low[grade == k].sum() - high[grade == k - 1].sum()) / n for k in range(1, top + 1)])
        g = np.zeros_like(theta)
        g[:SIZE] = np.bincount(feature, by_score[row] * value, minlength=SIZE) + ridge * theta[:SIZE]
        g[SIZE] = by_t.sum()
        for k in range(1, top):
            g[SIZE + k] = by_t[k:].sum() * np.exp(theta[SIZE + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(theta[:SIZE], thresholds())


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade) of the rated documents: 0 bad and toxic, 1 bad, 2 good
    but toxic, 3 good. Rows without an id or a quality are left out; no
    toxicity counts as none."""
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(0)) > 0
    return labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), (F.when(F.col("quality") > 0, 2).otherwise(0) + F.when(toxic, 0).otherwise(1)).alias("grade")
    )


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grades = batch.column(0)
        for begin, end, data, offsets in text_chunks(batch.column(1)):
            row, feature, value = features(data, offsets)
            order = np.argsort(row, kind="stable")
            cut = pa.array(np.searchsorted(row[order], np.arange(end - begin + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([grades.slice(begin, end - begin), *lists], names=["grade", "feature", "value"])


def fit_quality(docs: DataFrame, grades: DataFrame, max_rated: int = MAX_RATED, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """The model fitted on at most ``max_rated`` rated documents; none if no
    document is rated."""
    sample = grades.select("doc_id", "grade").distinct().orderBy(F.xxhash64("doc_id", "grade"), "doc_id", "grade").limit(max_rated)
    chosen = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rated = chosen.join(F.broadcast(sample), "doc_id").select(F.col("grade").cast("int").alias("grade"), "text")
    # Ids may repeat among the documents; the bound holds for their rows, too.
    rated = rated.orderBy(F.xxhash64("text", "grade")).limit(2 * max_rated)
    found = rated.mapInArrow(_sample_features, "grade int, feature array<int>, value array<float>").toArrow()
    grade = found.column("grade").to_numpy().astype(np.int64)
    if not len(grade):
        return None
    lengths = found.column("feature").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(grade)), lengths)
    feature, value = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "value"))
    return fit_ordinal(row, feature.astype(np.int64), value.astype(np.float64), grade, 3)


def with_quality(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` with a struct ``quality_score``: ``expected_grade``, ``p_good``
    (P(grade >= 2)), ``p_clean`` (P(grade >= 3)) and ``accepted`` (``p_good >=
    cut``).

    A null or empty text has no features and gets what the thresholds alone
    say; without a model (nothing is rated) all are accepted with null
    figures. Other columns pass through.
    """
    kind = "expected_grade double, p_good double, p_clean double, accepted boolean"
    if model is None:
        empty = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("expected_grade", "p_good", "p_clean")), F.lit(True).alias("accepted"))
        return docs.withColumn("quality_score", empty)
    @F.pandas_udf(kind)
    def score(text: pd.Series) -> pd.DataFrame:
        parts = [model.scores(data, offsets) for _, _, data, offsets in text_chunks(pa.array(text, pa.large_string(), from_pandas=True))]
        tails = model.tails(np.concatenate(parts) if parts else np.zeros(0))
        good = tails[:, GOOD_GRADE - 1]
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_good": good, "p_clean": tails[:, -1], "accepted": good >= cut})

    return docs.withColumn("quality_score", score(text_of(text_col)))
