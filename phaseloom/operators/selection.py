"""Choosing between state models: refits over a grid of settings, models side by side on the same frames, paired tests of videos."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators import hmm, metrics, scan, trajectory


def changes(series: DataFrame, k: int = 1) -> DataFrame:
    """video, frame, phase, label: whether the phase differs from that k frames before; null where that frame, or one between, is not in the series."""
    along = W.partitionBy("video").orderBy("frame")
    whole = F.lag("frame", k).over(along) == F.col("frame") - k
    return series.select("video", "frame", "phase", F.when(whole, (F.col("phase") != F.lag("phase", k).over(along)).cast("long")).alias("label"))


def scored(preds: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: auroc, brier, accuracy, n of (prob, label)."""
    gap = F.col("prob") - F.col("label")
    own = preds.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"), F.avg(((F.col("prob") >= 0.5).cast("long") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return metrics.auroc(preds, keys).join(own, keys).select(*keys, "auroc", "brier", "accuracy", "n")


def hmm_sweep(train: DataFrame, asked: DataFrame, truth: DataFrame, alphas: list[float], rhos: list[float], k: int = 7) -> DataFrame:
    """config_no, alpha, rho, phase_accuracy, log_likelihood (a frame), auroc, brier, accuracy, n: hidden-Markov models fitted anew on `train` for each pair of settings.

    `asked` holds (video, frame, emission), `truth` the phases of the same frames. What is scored is whether the phase changed within k frames, where the frame k before is there; the
    first two columns are over all frames. Counts of transitions are made once for each setting on the executors; a setting brings a matrix of fixed size here.
    """
    log_pi = hmm.log_table(hmm.initial_distribution(train))
    runs, rate = trajectory.segments(train), changes(train, k).agg(F.avg("label")).first()[0]
    decoded, settings = None, [(a, r) for a in alphas for r in rhos]
    for number, (alpha, rho) in enumerate(settings):
        log_a = hmm.log_table(hmm.transition_probabilities(train, runs, alpha, rho))
        one = scan.decode(asked, log_pi, log_a, k, float(rate or 0.0), smooth=False)
        one = one.select(F.lit(number).cast("long").alias("config_no"), F.lit(float(alpha)).alias("alpha"), F.lit(float(rho)).alias("rho"), "video", "frame", "state", "log_norm", F.col("change_k").alias("prob"))
        decoded = one if decoded is None else decoded.unionByName(one)
    keys = ["config_no", "alpha", "rho"]
    rows = decoded.join(changes(truth, k), ["video", "frame"])
    named = rows.groupBy(*keys).agg(F.avg((F.col("state") == F.col("phase")).cast("double")).alias("phase_accuracy"), F.avg("log_norm").alias("log_likelihood"))
    return named.join(scored(rows.filter("label is not null"), keys), keys)


def video_deltas(rows: DataFrame) -> DataFrame:
    """video, n, observed, brier_a, brier_b, delta (b - a) of (video, label, a, b): two models' probabilities of the same frames. Rows with a null label or probability are left out of both."""
    known = rows.filter("label is not null and a is not null and b is not null")
    gap = {c: F.avg(F.pow(F.col(c) - F.col("label"), F.lit(2))) for c in ("a", "b")}
    out = known.groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("observed"), gap["a"].alias("brier_a"), gap["b"].alias("brier_b"))
    return out.withColumn("delta", F.col("brier_b") - F.col("brier_a"))


def t_test_p(t: float | None, df: int) -> float | None:
    """Two-sided p of a t statistic; null where there is none."""
    if t is None or df < 1:
        return None
    scale, steps = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi), 4000
    # in u = atan(x / sqrt(df)) the density is a power of a cosine on a finite interval
    end = math.atan(abs(t) / math.sqrt(df))
    f = [math.cos(end * i / steps) ** (df - 1) for i in range(steps + 1)]
    inside = scale * math.sqrt(df) * end / steps / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
    return min(1.0, max(0.0, 1 - 2 * inside))


def p_value(test, *columns: Column) -> Column:
    """A test's p for each row of a small table of statistics, a batch at a time; null where the test gives none."""

    def run(*batches: pa.Array) -> pa.Array:
        return pa.array([test(*row) for row in zip(*(b.to_pylist() for b in batches), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(*columns)


def paired_tests(deltas: DataFrame, column: str = "delta") -> DataFrame:
    """One row: n, mean, std, median, n_better (below zero), n_worse, n_tied, t, w_plus, w_minus, sign_p, ttest_p, wilcoxon_p.

    A video counts once, whatever its length. Without spread t and its p are null; where all differences are within 1e-8 of zero, the signed-rank p is 1.
    Ranks are counted over sizes in blocks, so no task sorts all videos.
    """
    rows = deltas.filter(F.col(column).isNotNull()).select(F.col(column).alias("d"))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.median("d").alias("median"), F.count_if(F.col("d") < 0).alias("n_better"), F.count_if(F.col("d") > 0).alias("n_worse"),
        F.count_if(F.col("d") == 0).alias("n_tied"), F.coalesce(F.max(F.abs("d")) <= 1e-8, F.lit(True)).alias("_same"),
    )
    one = facts.join(metrics.paired_difference(rows.select(F.lit(0.0).alias("a"), F.col("d").alias("b"))))
    one = one.withColumn("t", F.when(F.col("std") > 0, F.col("mean") / (F.col("std") / F.sqrt("n"))))
    sign = p_value(metrics.sign_test_p, F.col("n_better"), F.col("n_worse"))
    ranks = p_value(metrics.wilcoxon_p, F.col("w_plus"), F.col("w_minus"), F.col("n_nonzero"), F.col("_same"), F.col("tie_term"))
    own = ["n", "mean", "std", "median", "n_better", "n_worse", "n_tied", "t", "w_plus", "w_minus"]
    return one.select(*own, sign.alias("sign_p"), p_value(t_test_p, F.col("t"), F.col("n") - 1).alias("ttest_p"), ranks.alias("wilcoxon_p"))
