"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Each indicator is scaled by the log ratio of its smoothed class counts; a linear hinge-loss model is
then fitted by dual coordinate descent, and its margins are mapped to probabilities.

Defined cases: null and empty texts have no features and get the score of the bias; ids that are
null are never taught and never held out; repeated rows are scored alike; without labels every
document scores 0.5, with one class only that class; columns beside doc_id and text are ignored by
`score` and kept by `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .learning import fit_in_one_task, held_out, labelled_sample
from .textfeat import ngram_keys

BITS = 20
#: Bound of the labelled rows that a fit reads: it fixes the memory of the one fitting task.
TRAIN_ROWS = 16_000


def dual_descent(y: np.ndarray, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, dim: int, rows: np.ndarray, c: float = 1.0, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Weights (the last one for a constant feature) of min |w|^2/2 + c sum hinge over `rows`, y in {-1, 1}."""
    n, w = len(y), np.zeros(dim + 1)
    alpha, order = np.zeros(n), np.random.default_rng(seed)
    norm = np.array([val[a:b] @ val[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)], float) + 1.0
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(rows):
            a, b = ptr[i], ptr[i + 1]
            j, v = idx[a:b], val[a:b]
            g = y[i] * (w[j] @ v + w[dim]) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                w[j] += step * v
                w[dim] += step
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def logistic_fit(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that map margins to probabilities, by Newton steps on smoothed targets."""
    pos, neg = t.sum(), (1 - t).sum()
    t = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, ab = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * ab
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), grad)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def fit_model(labels: np.ndarray, ptr: np.ndarray, idx: np.ndarray) -> bytes:
    """Ratios, weights and calibration as bytes: float64 (slope, intercept, bias), then float32 arrays."""
    dim, t = 1 << BITS, (labels == 1).astype(np.int64)
    if t.min() == t.max():
        return np.array([0.0, 30.0 if t[0] else -30.0, 0.0]).tobytes() + np.zeros(2 * dim, np.float32).tobytes()
    df, pos = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    each = list(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True))
    for (a, b), yes in zip(each, t, strict=True):  # a row's features differ
        df[idx[a:b]] += 1
        if yes:
            pos[idx[a:b]] += 1
    p, q = pos + 1.0, df - pos + 1.0
    ratio = np.where(df >= 2, np.log(p / t.sum()) - np.log(q / (1 - t).sum()), 0.0).astype(np.float32)
    val = ratio[idx]
    for a, b in each:
        val[a:b] /= max(np.sqrt(val[a:b] @ val[a:b]), 1e-9)
    y = np.where(t == 1, 1.0, -1.0)
    rows = np.arange(len(t))
    test = rows % 5 == 4
    if test.any() and 0 < t[test].sum() < test.sum() and 0 < t[~test].sum() < (~test).sum():
        w = dual_descent(y, ptr, idx, val, dim, rows[~test])
        m = np.array([w[idx[a:b]] @ val[a:b] for a, b in each]) + w[dim]
        a, b = logistic_fit(m[test], t[test])
    else:
        a, b = 2.0, 0.0
    w = dual_descent(y, ptr, idx, val, dim, rows)
    return np.array([a, b, w[dim]]).tobytes() + ratio.tobytes() + w[:-1].astype(np.float32).tobytes()


class QualityClassifier:
    """fit() on labelled documents, then score() or keep() any documents."""

    def __init__(self, model: bytes | None):
        self.model = model

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> QualityClassifier:
        """docs (doc_id, text), labels (doc_id, quality 0/1). `most` bounds the labelled rows used."""
        return cls(fit_in_one_task(docs, labelled_sample(labels, "quality", most), fit_model, BITS))

    def _scorer(self, spark: SparkSession):
        shared, dim = spark.sparkContext.broadcast(self.model), 1 << BITS

        def score(texts: pa.Array) -> np.ndarray:
            n = len(texts)
            if shared.value is None:
                return np.full(n, 0.5)
            a, b, bias = np.frombuffer(shared.value, np.float64, 3)
            ratio, w = np.frombuffer(shared.value, np.float32, offset=24).reshape(2, dim)
            row, idx = ngram_keys(texts, BITS)
            r = ratio[idx].astype(np.float64)
            m = np.bincount(row, r * w[idx], n) / np.maximum(np.sqrt(np.bincount(row, r * r, n)), 1e-9) + bias
            return 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))

        return score

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row."""
        score = self._scorer(prepare(docs.sparkSession))
        src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)))], ["doc_id", "score"])

        return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, score double")

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows that score at least 0.5, all columns as they were."""
        score = self._scorer(prepare(docs.sparkSession))

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(score(b.column(b.schema.get_field_index("text"))) >= 0.5))

        return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = QualityClassifier.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return QualityClassifier.fit(docs, table(spark, sf_dir, "labels")).keep(docs)
