"""A registry of models that turn trajectories of vectors into the probability that a window's phase changes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators import metrics, vectors

#: Models by name. Each gets training and other rows (video, window_start, embedding, consistency_flag) and adds prob to the latter.
MODELS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def model(name: str):
    """Registers a model; a name is given once."""

    def put(f: Callable[[DataFrame, DataFrame], DataFrame]):
        if name in MODELS:
            raise ValueError(f"model {name!r} is registered already")
        MODELS[name] = f
        return f

    return put


def _logistic(train: DataFrame, test: DataFrame, feature: str) -> DataFrame:
    """prob of one array feature by logistic regression; rows without it get the base rate."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = train.filter(F.col(feature).isNotNull()).withColumn("_f", array_to_vector(feature))
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.min("consistency_flag").alias("low"), F.max("consistency_flag").alias("high")).first()
    rate = base_rate_of(train)
    if not facts["n"] or facts["low"] == facts["high"]:
        return test.withColumn("prob", F.lit(rate))
    fitted = LogisticRegression(featuresCol="_f", labelCol="consistency_flag", regParam=1.0 / facts["n"], standardization=False, predictionCol="_y", rawPredictionCol="_r", probabilityCol="_p").fit(known)
    scored = fitted.transform(test.filter(F.col(feature).isNotNull()).withColumn("_f", array_to_vector(feature)))
    scored = scored.withColumn("prob", vector_to_array("_p")[1]).drop("_f", "_y", "_r", "_p")
    return scored.unionByName(test.filter(F.col(feature).isNull()).withColumn("prob", F.lit(rate)))


def base_rate_of(train: DataFrame) -> float:
    """The mean flag, 0.5 without rows."""
    return float(train.agg(F.coalesce(F.avg("consistency_flag"), F.lit(0.5)).alias("r")).first()["r"])


@model("base_rate")
def base_rate(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.withColumn("prob", F.lit(base_rate_of(train)))


def _with_step(rows: DataFrame) -> DataFrame:
    step = vectors.consecutive_distance(rows, "video", "window_start", "embedding")
    return step.withColumn("_x", F.when(F.col("step").isNotNull(), F.array("step"))).drop("step")


@model("persistence")
def persistence(train: DataFrame, test: DataFrame) -> DataFrame:
    """By how far the vector moved since the window before; the first window gets the base rate."""
    return _logistic(_with_step(train), _with_step(test), "_x").drop("_x")


@model("identity")
def identity(train: DataFrame, test: DataFrame) -> DataFrame:
    """By the vector itself."""
    own = F.transform("embedding", lambda x: x.cast("double"))
    return _logistic(train.withColumn("_x", own), test.withColumn("_x", own), "_x").drop("_x")


@model("linear_dynamics")
def linear(train: DataFrame, test: DataFrame) -> DataFrame:
    """By how far the vector is from where linear dynamics, fitted on the training rows, expect it."""
    a, b = vectors.linear_dynamics(train, "video", "window_start", "embedding")
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in a])
    shift = F.array(*[F.lit(float(x)) for x in b])

    def residual(rows: DataFrame) -> DataFrame:
        before = F.lag("embedding").over(W.partitionBy("video").orderBy("window_start"))
        rows = rows.withColumn("_b", before)
        ahead = F.zip_with(F.transform(table, lambda row: vectors.dot(row, F.col("_b"))), shift, lambda x, y: x + y)
        return rows.withColumn("_x", F.when(F.col("_b").isNotNull(), F.array(vectors.distance(ahead, F.col("embedding"))))).drop("_b")

    return _logistic(residual(train), residual(test), "_x").drop("_x")


def imputed(rows: DataFrame, a: np.ndarray, b: np.ndarray, group: str = "video", order: str = "window_start", vector: str = "embedding") -> DataFrame:
    """Adds guess: the vector that the one before leads to, averaged with the one that leads to the next if A can be inverted well (condition up to 1e8)."""
    along = W.partitionBy(group).orderBy(order)

    def moved(m: np.ndarray, shift: np.ndarray, v):
        table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])
        out = F.zip_with(F.transform(table, lambda row: vectors.dot(row, v)), F.array(*[F.lit(float(x)) for x in shift]), lambda x, y: x + y)
        return F.when(v.isNotNull(), out)

    forth = moved(a, b, F.lag(vector).over(along))
    if np.linalg.cond(a) > 1e8:
        return rows.withColumn("guess", forth)
    inverse = np.linalg.inv(a)
    back = moved(inverse, -inverse @ b, F.lead(vector).over(along))
    return rows.withColumn("guess", F.coalesce(F.zip_with(forth, back, lambda x, y: (x + y) / 2), forth, back))


def ladder(train: DataFrame, test: DataFrame, names: list[str] | None = None) -> DataFrame:
    """model, auroc, brier, accuracy, n of the named models, all by default, on the same rows."""
    out = None
    for name in names or sorted(MODELS):
        preds = MODELS[name](train, test).select("prob", F.col("consistency_flag").alias("label"))
        one = metrics.auroc(preds).join(metrics.brier(preds)).join(metrics.binary_metrics(preds).select("accuracy")).select(F.lit(name).alias("model"), "auroc", "brier", "accuracy", "n")
        out = one if out is None else out.unionByName(one)
    return out


def seed_interval(values: list[float], level: float = 0.95) -> tuple[float, float | None, float | None, float | None]:
    """mean, sample deviation and t-interval of a few repetitions; NaN are left out, one value has no interval."""
    own = [v for v in values if v == v]
    if not own:
        return float("nan"), None, None, None
    mean = float(np.mean(own))
    if len(own) == 1:
        return mean, None, None, None
    std = float(np.std(own, ddof=1))
    half = metrics.t_quantile(1 - (1 - level) / 2, len(own) - 1) * std / np.sqrt(len(own))
    return mean, std, mean - half, mean + half
