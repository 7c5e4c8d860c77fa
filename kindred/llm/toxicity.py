"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds and
theta_1 < theta_2 < ...; the expected severity is the sum of these probabilities.

The labels say toxic or not. Grades come from them and from the taught texts alone: 0 is not toxic;
toxic documents get 1, or 2 if they hold more than the median number of marker words, which are words
with smoothed log odds of at least 3 for toxic documents.

Defined cases: null and empty texts have no features; without labels nothing is toxic (probabilities
0); null ids are never taught; repeated rows are scored alike; columns beside doc_id and text are
ignored by `score` and kept by `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .learning import fit_in_one_task, labelled_sample
from .textfeat import ngram_keys

BITS = 20
TRAIN_ROWS = 16_000
FEATURES = {"bigrams": False, "shapes": False}
GRADES = 3


def severity_grades(toxic: np.ndarray, ptr: np.ndarray, idx: np.ndarray, dim: int) -> np.ndarray:
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(ptr))
    df, pos = np.bincount(idx, minlength=dim), np.bincount(idx[toxic[row] == 1], minlength=dim)
    odds = np.log((pos + 0.5) / (toxic.sum() + 1)) - np.log((df - pos + 0.5) / ((1 - toxic).sum() + 1))
    n = np.bincount(row, ((odds >= 3) & (df >= 5))[idx], len(toxic))
    middle = np.median(n[toxic == 1]) if toxic.any() else 0
    return np.where(toxic == 1, 1 + (n > middle), 0)


def feature_scales(toxic: np.ndarray, ptr: np.ndarray, idx: np.ndarray, dim: int) -> np.ndarray:
    """0 for rare features and for those whose smoothed log odds are within two standard errors of 0;
    else in proportion to these odds and the logarithm of the feature's frequency, 1 at most."""
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(ptr))
    df, pos = np.bincount(idx, minlength=dim), np.bincount(idx[toxic[row] == 1], minlength=dim)
    odds = np.log((pos + 0.5) / (toxic.sum() + 1)) - np.log((df - pos + 0.5) / ((1 - toxic).sum() + 1))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (df - pos + 0.5))
    scale = np.where((df >= 5) & (np.abs(odds) >= 2 * error), np.abs(odds) * np.log1p(df), 0)
    return scale / max(scale.max(), 1e-9)


def fit_ordinal(y: np.ndarray, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, dim: int, grades: int, rounds: int = 200, rate: float = 0.5, penalty: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model, by adaptive gradient steps.

    The likelihood of grade k is s(theta_{k+1} - w.x) - s(theta_k - w.x); thresholds stay in order
    because each is the one before plus the exponential of a free parameter.
    """
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(ptr))
    share = np.array([(y >= k).mean() for k in range(1, grades)]).clip(0.5 / n, 1 - 0.5 / n)
    theta = -np.log(share / (1 - share))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    w, gw, gf = np.zeros(dim), np.full(dim, 1e-8), np.full(grades - 1, 1e-8)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(rounds):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(row, w[idx] * val, n)
        high = np.concatenate([theta, [np.inf]])[y]
        low = np.concatenate([[-np.inf], theta])[y]
        a, b = sig(high - z), sig(low - z)
        like = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        slope = (da - db) / like / n  # of the mean negative log likelihood in z
        g = np.bincount(idx, slope[row] * val, dim) + penalty * w / n
        up = np.bincount(y, db / like / n, grades)
        dt = up[1:] - np.bincount(y, da / like / n, grades)[:-1]
        gfree = np.concatenate([[dt.sum()], np.exp(free[1:]) * dt[::-1].cumsum()[::-1][1:]])
        gw += g * g
        gf += gfree * gfree
        w = w - rate / np.sqrt(gw) * g
        free = free - rate / np.sqrt(gf) * gfree
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit_model(labels: np.ndarray, ptr: np.ndarray, idx: np.ndarray) -> bytes:
    dim, toxic = 1 << BITS, (labels == 1).astype(np.int64)
    if not toxic.any() or toxic.all():
        return np.full(GRADES - 1, 40.0 if not toxic.any() else -40.0).tobytes() + np.zeros(dim, np.float32).tobytes()
    y = severity_grades(toxic, ptr, idx, dim)
    scale = feature_scales(toxic, ptr, idx, dim)
    keep = scale[idx] > 0  # the others have weight 0; few are left
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ptr))[keep]
    used, idx = np.unique(idx[keep], return_inverse=True)
    ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(y)))])
    found, theta = fit_ordinal(y, ptr, idx, scale[used][idx], len(used), GRADES)
    w = np.zeros(dim)
    w[used] = found * scale[used]
    return theta.tobytes() + w.astype(np.float32).tobytes()


class ToxicityModel:
    def __init__(self, model: bytes | None):
        self.model = model

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> ToxicityModel:
        """docs (doc_id, text), labels (doc_id, toxic 0/1). `most` bounds the labelled rows used."""
        return cls(fit_in_one_task(docs, labelled_sample(labels, "toxic", most), fit_model, BITS, **FEATURES))

    def _scorer(self, spark: SparkSession):
        shared = spark.sparkContext.broadcast(self.model)

        def at_least(texts: pa.Array) -> np.ndarray:
            """P(grade >= k) by row and k >= 1."""
            n = len(texts)
            if shared.value is None:
                return np.zeros((n, GRADES - 1))
            theta = np.frombuffer(shared.value, np.float64, GRADES - 1)
            w = np.frombuffer(shared.value, np.float32, offset=8 * (GRADES - 1))
            row, idx = ngram_keys(texts, BITS, **FEATURES)
            z = np.bincount(row, w[idx], n)
            return 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))

        return at_least

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, p_1 .., severity, grade, toxic): severity is the expected grade, grade the likeliest."""
        at_least = self._scorer(prepare(docs.sparkSession))
        src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        names = ["doc_id", *[f"p_{k}" for k in range(1, GRADES)], "severity", "grade", "toxic"]

        def run(batches):
            for b in batches:
                p = at_least(b.column(1))
                each = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
                cols = [pa.array(p[:, k]) for k in range(GRADES - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], names)

        kinds = [dict(src.dtypes)["doc_id"], *["double"] * GRADES, "int", "boolean"]
        return src.mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows that are likelier not toxic, all columns as they were."""
        at_least = self._scorer(prepare(docs.sparkSession))

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(at_least(b.column(b.schema.get_field_index("text")))[:, 0] < 0.5))

        return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ToxicityModel.fit(docs, table(spark, sf_dir, "labels")).score(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier not toxic."""
    return ToxicityModel.fit(docs, table(spark, sf_dir, "labels")).keep(docs)
