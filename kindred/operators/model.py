"""Boosted trees in two stages, masked labels, calibration, release bundles and bootstrap bounds, on the public ML library."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Files, fingerprint, written
from .decide import TGT, competition

KEYS = [*TGT, "ref_id"]
#: Names of the second stage's further features, in order.
STAGE2 = ("s1", "t_n", "t_rank", "t_gap_other", "t_n_hi", "r_n", "r_rank", "r_gap_max", "r_n_hi")
TEACHERS = ("F", "B")


@dataclass(frozen=True)
class TrainConfig:
    """Depth-wise trees: `depth` stands for a bound on leaves, `bins` and `least` (rows in a leaf) as named."""

    rounds: int = 200
    rate: float = 0.05
    depth: int = 6
    bins: int = 128
    least: int = 100
    seed: int = 0


def fold(ref: str = "ref_id", folds: int = 2) -> Column:
    # The multiplier and modulus of the fold hash.
    return F.pmod(F.pmod(F.col(ref) * F.lit(2654435761), F.lit(1000003)), F.lit(folds))


def with_roles(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds ref_role and tgt_role, null where there is none."""
    side = lambda key, name: roles.select(F.col("rec_id").alias(key), F.col("role").alias(name))
    return edges.join(side("ref_id", "ref_role"), "ref_id", "left").join(side("tgt_id", "tgt_role"), "tgt_id", "left")


def teaches(roles: tuple[str, ...] = TEACHERS) -> Column:
    """Whether both ends of an edge with_roles() may teach."""
    return F.coalesce(F.col("ref_role").isin(*roles) & F.col("tgt_role").isin(*roles), F.lit(False))


def with_labels(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1.0 for true links, else 0.0."""
    true = truth.select("ref_id", "tgt_id").distinct().withColumn("true_", F.lit(1.0))
    return edges.join(true, ["ref_id", "tgt_id"], "left").withColumn("label", F.coalesce("true_", F.lit(0.0))).drop("true_")


def supervised(edges: DataFrame, truth: DataFrame, role: str = "F") -> DataFrame:
    """Edges with_roles() and label: null, not negative, for targets of another role, as their owners are withheld; links
    count only from references of the role."""
    known = with_labels(edges, truth)
    right = F.when(F.col("ref_role") == role, F.col("label")).otherwise(0.0)
    return known.withColumn("label", F.when(F.col("tgt_role") == role, right))


def train_model(rows: DataFrame, features: list[str], config: TrainConfig = TrainConfig()) -> PipelineModel:
    """A model of rows (features, label); rows without a label don't teach."""
    x = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="error")
    known = rows.where("label is not null")
    if known.select("label").distinct().count() < 2:
        raise ValueError("both labels are needed to train")
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=config.rounds, maxDepth=config.depth, stepSize=config.rate, maxBins=config.bins, minInstancesPerNode=config.least, seed=config.seed)
    return PipelineModel([x, trees.fit(x.transform(known))])


def predict(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """rows with the probability of a link as `name`."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def save_model(model: PipelineModel, path: str) -> str:
    """Writes the model, replacing what is there; its fingerprint."""
    model.write().overwrite().save(path)
    return model_fingerprint(model.stages[-1])


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_fingerprint(model: PipelineModel) -> str:
    trees = model.stages[-1] if isinstance(model, PipelineModel) else model
    return fingerprint(trees.toDebugString.split("\n", 1)[1], json.dumps(list(trees.treeWeights)))


def importances(model: PipelineModel, most: int = 20) -> list[tuple[str, float]]:
    """The most important features, largest first."""
    names, values = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:most]


def out_of_fold(edges: DataFrame, features: list[str], config: TrainConfig = TrainConfig(), folds: int = 2) -> tuple[DataFrame, list[PipelineModel]]:
    """(edges with s, models) of edges with features, label and the boolean `fits`. Edges that teach are scored by the model
    of the other folds, others by the mean of all."""
    x = written(edges.withColumn("fold", fold(folds=folds)))
    models = []
    for k in range(folds):
        models.append(train_model(x.where(F.col("fits") & (F.col("fold") != k)), features, TrainConfig(**{**asdict(config), "seed": config.seed + k})))
    out = x
    for k, m in enumerate(models):
        out = predict(m, out, f"p{k}")
    each = [F.col(f"p{k}") for k in range(folds)]
    own = F.element_at(F.array(*each), (F.col("fold") + 1).cast("int"))
    return out.withColumn("s", F.when(F.col("fits"), own).otherwise(sum(each, F.lit(0.0)) / folds)).drop("fold", *[f"p{k}" for k in range(folds)]), models


def mean_score(models: list[PipelineModel], edges: DataFrame) -> DataFrame:
    """edges with s, the mean of the models' probabilities."""
    out = edges
    for k, m in enumerate(models):
        out = predict(m, out, f"p{k}")
    return out.withColumn("s", sum((F.col(f"p{k}") for k in range(len(models))), F.lit(0.0)) / len(models)).drop(*[f"p{k}" for k in range(len(models))])


def with_competition(edges: DataFrame) -> DataFrame:
    """edges with a score s, and STAGE2 of it."""
    c = competition(edges.select(*KEYS, F.col("s").alias("score")))
    return edges.join(c.select(*KEYS, *[F.col(n).cast("double").alias(n) for n in STAGE2]), KEYS)


def two_stages(edges: DataFrame, features: list[str], config: TrainConfig = TrainConfig(), second: TrainConfig | None = None) -> tuple[DataFrame, list[PipelineModel], PipelineModel]:
    """(edges with s and score, models of the first stage, model of the second): the second learns from all features and
    the competition of the first's out-of-fold scores."""
    first, models = out_of_fold(edges, features, config)
    x = written(with_competition(first))
    last = train_model(x.where("fits"), [*features, *STAGE2], second or TrainConfig(**{**asdict(config), "seed": 7}))
    return predict(last, x, "score"), models, last


def platt_fit(rows: DataFrame) -> tuple[float, float]:
    """(a, b) of 1/(1 + exp(a s + b)), a <= 0, of rows (score, label)."""
    x = VectorAssembler(inputCols=["score"], outputCol="x").transform(rows.where("label is not null"))
    m = LogisticRegression(featuresCol="x", labelCol="label", lowerBoundsOnCoefficients=Matrices.dense(1, 1, [0.0]), standardization=False).fit(x)
    return -float(m.coefficients[0]), -float(m.intercept)


def poisson_bounds() -> list[float]:
    """The cumulated Poisson(1) probabilities as far as doubles below 1 tell them apart."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, 40):
        total += term
        if total > 1 - 2.0**-53:
            break
        out.append(total)
        term /= k
    return out


def bootstrap_bound(deltas: DataFrame, rounds: int = 200, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """One row (mean, lower) of paired differences (ref_id, delta): their mean and its lower bound at `confidence`, by
    drawing every reference as often as a Poisson variable of its hash says, in each round."""
    u = F.xxhash64("ref_id", "r", F.lit(seed)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    weight = sum(((u >= e).cast("int") for e in poisson_bounds()), F.lit(0))
    drawn = deltas.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).groupBy("r").agg((F.sum(F.col("delta") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("m"))
    return drawn.agg(F.percentile("m", F.lit(1 - confidence)).alias("lower")).crossJoin(deltas.agg(F.avg("delta").alias("mean"))).select("mean", "lower")  # one row each


# Release bundles

#: What a bundle must agree with when it is used.
CHECKED = ("models", "features", "recipe")


def feature_version(features: list[str]) -> str:
    return fingerprint(*features)[:16]


def write_release(spark: SparkSession, path: str, bundle: dict) -> None:
    Files(spark).write(path, json.dumps(bundle, indent=2).encode())


def read_release(spark: SparkSession, path: str, **expected) -> dict:
    """The bundle, if what it says of CHECKED is what is expected (models: fingerprints, features: version, recipe); else an error."""
    bundle = json.loads(Files(spark).read(path))
    for k in CHECKED:
        if k in expected and bundle.get(k) != expected[k]:
            raise ValueError(f"the release's {k} differ from those in use")
    return bundle
