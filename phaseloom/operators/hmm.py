"""Hidden-Markov and explicit-duration models of phases: parameters by aggregation, recursions per video."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators.trajectory import N_PHASES, phase_grid, segments

#: Stands for the logarithm of zero: finite, so that differences of impossible paths stay numbers.
NEVER = -1e10


def initial_distribution(series: DataFrame, n: int = N_PHASES) -> DataFrame:
    """phase, p: the share of videos that begin in each phase; uniform without videos."""
    first = series.groupBy("video").agg(F.min_by("phase", "frame").alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("k"))
    grid = series.sparkSession.range(n).select(F.col("id").alias("phase")).join(F.broadcast(first), "phase", "left").na.fill(0, ["k"])
    total = F.sum("k").over(W.partitionBy())
    return grid.select("phase", F.when(total > 0, F.col("k") / total).otherwise(F.lit(1.0 / n)).alias("p"))


def window_transitions(series: DataFrame) -> DataFrame:
    """a, b, n: neighbouring frames of one video whose phase does not fall."""
    along = W.partitionBy("video").orderBy("frame")
    pairs = series.select(F.col("phase").alias("a"), F.lead("phase").over(along).alias("b")).filter("b >= a")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def segment_transitions(runs: DataFrame, strict: bool = False) -> DataFrame:
    """a, b, n: neighbouring segments whose phase does not fall (or rises, if strict)."""
    along = W.partitionBy("video").orderBy("seg_no")
    pairs = runs.select(F.col("phase").alias("a"), F.lead("phase").over(along).alias("b")).filter("b > a" if strict else "b >= a")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _forward_rows(grid: DataFrame, counts: DataFrame, alpha: float, rho: float) -> DataFrame:
    """a, b, m: smoothed shares of the phases above each phase: counts plus alpha times a prior that falls by rho per phase skipped."""
    rows = grid.filter("b > a").join(F.broadcast(counts.filter("b > a")), ["a", "b"], "left").na.fill(0, ["n"])
    fall = F.pow(F.lit(rho), F.col("b") - F.col("a") - 1)
    own = W.partitionBy("a")
    mass = F.col("n") + F.lit(alpha) * fall / F.sum(fall).over(own)
    total = F.sum(mass).over(own)
    return rows.select("a", "b", F.when(total > 0, mass / total).otherwise(0.0).alias("m"))


def transition_probabilities(series: DataFrame, runs: DataFrame, alpha: float = 2.0, rho: float = 0.5, n: int = N_PHASES) -> DataFrame:
    """a, b, p of the hidden-Markov model for all pairs: staying by its share of the pairs from a, leaving forward by segment counts with a prior; phases that were never left stay for sure."""
    counts = window_transitions(series)
    stay = counts.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("all"))
    grid = phase_grid(series.sparkSession, n)
    forward = _forward_rows(grid, segment_transitions(runs), alpha, rho)
    rows = grid.join(F.broadcast(forward), ["a", "b"], "left").join(F.broadcast(stay), "a", "left")
    keep = F.when((F.col("all") > 0) & (F.col("a") < n - 1), F.col("same") / F.col("all")).otherwise(1.0)
    p = F.when(F.col("a") == F.col("b"), keep).when(F.col("b") > F.col("a"), (1 - keep) * F.coalesce("m", F.lit(0.0))).otherwise(0.0)
    return rows.select("a", "b", p.alias("p"))


def segment_probabilities(runs: DataFrame, alpha: float = 2.0, rho: float = 0.5, n: int = N_PHASES) -> DataFrame:
    """a, b, p of the explicit-duration model: strictly forward; the last phase leads nowhere."""
    grid = phase_grid(runs.sparkSession, n)
    rows = grid.join(F.broadcast(_forward_rows(grid, segment_transitions(runs, strict=True), alpha, rho)), ["a", "b"], "left")
    return rows.select("a", "b", F.coalesce("m", F.lit(0.0)).alias("p"))


def state_prior(series: DataFrame, epsilon: float = 1.0, n: int = N_PHASES) -> DataFrame:
    """phase, p = (rows of the phase + epsilon) / (all rows + n * epsilon)."""
    counts = series.groupBy("phase").agg(F.count(F.lit(1)).alias("k"))
    grid = series.sparkSession.range(n).select(F.col("id").alias("phase")).join(F.broadcast(counts), "phase", "left").na.fill(0, ["k"])
    return grid.select("phase", ((F.col("k") + epsilon) / (F.sum("k").over(W.partitionBy()) + n * epsilon)).alias("p"))


def base_rate(windows: DataFrame) -> DataFrame:
    """The mean flag, 0.5 without windows."""
    return windows.agg(F.coalesce(F.avg("consistency_flag"), F.lit(0.5)).alias("base_rate"))


def log_table(rows: DataFrame, n: int = N_PHASES) -> np.ndarray:
    """a, b, p (or phase, p) as an array of logarithms; the table has n * n rows at most."""
    found = rows.toPandas()
    out = np.zeros((n, n)) if "a" in found else np.zeros(n)
    out[tuple(found[c].to_numpy(int) for c in (("a", "b") if "a" in found else ("phase",)))] = found["p"]
    return np.where(out > 0, np.log(np.maximum(out, 1e-300)), NEVER)


def _logsumexp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass(frozen=True)
class Emissions:
    """A classifier of phases from features, and the phases' log-prior: what turns features into log-likelihoods of phases up to a constant."""

    weights: np.ndarray  # phases x features
    bias: np.ndarray
    log_prior: np.ndarray
    seen: np.ndarray


def fit_emissions(train: DataFrame, features: str, n: int = N_PHASES, epsilon: float = 1.0, ridge: float = 1e-3) -> Emissions:
    """Multinomial logistic regression of `phase` on an array of features, standardised, and the smoothed prior of phases.

    Rows without phase or features, or with a null among these, are left out. With fewer than two phases to tell apart there is no classifier:
    weights are zero and the prior uniform, so every phase is as likely.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.filter(F.col("phase").isNotNull() & F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull()))
    facts = rows.groupBy("phase").agg(F.max(F.size(features)).alias("dims")).orderBy("phase").collect()  # one row for each phase
    dims = max((r["dims"] for r in facts), default=0)
    if len(facts) < 2:
        return Emissions(np.zeros((n, dims)), np.zeros(n), np.full(n, -math.log(n)), np.ones(n, bool))
    phases = [r["phase"] for r in facts]
    place = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("phase")) - 1
    known = rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("x"), place.cast("double").alias("y"))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=ridge, standardization=True, maxIter=200).fit(known)
    prior = {r["phase"]: r["p"] for r in state_prior(rows, epsilon, n).collect()}
    weights, bias, seen = np.zeros((n, dims)), np.zeros(n), np.zeros(n, bool)
    weights[phases], bias[phases], seen[phases] = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), True
    return Emissions(weights, bias, np.log(np.array([prior[k] for k in range(n)])), seen)


def with_emissions(rows: DataFrame, model: Emissions, features: str) -> DataFrame:
    """Adds emission: log P(phase | features) - log P(phase) of every phase, NEVER for phases that training did not have; zeros where features are missing."""
    seen = np.flatnonzero(model.seen).tolist()
    dims = model.weights.shape[1]
    x = [F.get(F.col(features), F.lit(i)).cast("double") for i in range(dims)]
    # Plain columns instead of functions of arrays: Spark compiles them. Each step reads the columns of the one before, so nothing is computed twice.
    rows = rows.withColumn("_x", F.when(F.size(features) == dims, F.struct(*[c.alias(f"x{i}") for i, c in enumerate(x)])))

    def logit(k: int):
        return functools.reduce(lambda s, i: s + F.lit(float(model.weights[k, i])) * F.col(f"_x.x{i}"), range(dims), F.when(F.col("_x").isNotNull(), F.lit(float(model.bias[k]))))

    rows = rows.withColumn("_logits", F.struct(*[logit(k).alias(f"l{k}") for k in seen]))
    logits = {k: F.col(f"_logits.l{k}") for k in seen}
    rows = rows.withColumn("_top", F.greatest(*logits.values()) if len(seen) > 1 else logits[seen[0]])
    rows = rows.withColumn("_norm", F.col("_top") + F.ln(functools.reduce(lambda s, k: s + F.exp(logits[k] - F.col("_top")), seen, F.lit(0.0))))
    own = [logits[k] - F.col("_norm") - float(model.log_prior[k]) if k in logits else F.lit(NEVER) for k in range(len(model.bias))]
    whole = F.array(*[F.coalesce(c, F.lit(0.0)) for c in own])
    return rows.withColumn("emission", whole).drop("_x", "_logits", "_top", "_norm")


def forward(log_pi: np.ndarray, log_a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered log-posteriors and the log-likelihood."""
    out, total = np.empty_like(b), 0.0
    for t in range(len(b)):
        x = b[t] + (log_pi if t == 0 else _logsumexp(out[t - 1][:, None] + log_a, axis=0))
        norm = _logsumexp(x)
        out[t], total = x - norm, total + norm
    return out, total


def smoothed(log_pi: np.ndarray, log_a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log-posteriors given the whole series."""
    own, _ = forward(log_pi, log_a, b)
    back = np.zeros_like(b)
    for t in range(len(b) - 2, -1, -1):
        back[t] = _logsumexp(log_a + (b[t + 1] + back[t + 1])[None, :], axis=1)
    both = own + back
    return both - _logsumexp(both)[:, None]


def viterbi(log_pi: np.ndarray, log_a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest path and its score; the lowest phase wins ties."""
    score, came = log_pi + b[0], np.zeros(b.shape, int)
    for t in range(1, len(b)):
        step = score[:, None] + log_a
        came[t] = step.argmax(axis=0)
        score = step.max(axis=0) + b[t]
    path = np.empty(len(b), int)
    path[-1] = score.argmax()
    for t in range(len(b) - 1, 0, -1):
        path[t - 1] = came[t][path[t]]
    return path, float(score.max())


def change_within(log_pi: np.ndarray, log_a: np.ndarray, b: np.ndarray, k: int, rate: float, frames: np.ndarray | None = None) -> np.ndarray:
    """Probability, given all up to t, that the phase of the row k frames before differs from the phase at t.

    The partner is the row at exactly frame - k, with all frames between in the series; where there is none, the base rate. Without `frames` rows count as frames.
    All rows step together: k products of arrays by phase pairs, whatever the length.
    """
    n, own = b.shape[1], forward(log_pi, log_a, b)[0]
    out = np.full(len(b), rate)
    if len(b) <= k:
        return out
    paths = own[:-k, :, None] + np.where(np.eye(n, dtype=bool), 0.0, NEVER)[None]  # row, phase at t - k, phase now
    for s in range(1, k + 1):
        paths = np.stack([_logsumexp(paths + log_a[:, j][None, None, :], axis=2) for j in range(n)], axis=2) + b[s : len(b) - k + s][:, None, :]
    same = _logsumexp(np.diagonal(paths, axis1=1, axis2=2))
    out[k:] = 1 - np.exp(np.minimum(0.0, same - _logsumexp(paths.reshape(len(paths), -1))))
    return out if frames is None else np.where(np.concatenate([np.zeros(k, bool), frames[k:] - frames[:-k] == k]), out, rate)


def negative_binomial(mean: float, size: float, dmax: int) -> np.ndarray:
    """P(duration = 1..dmax) of 1 + NB; what lies beyond is put on dmax."""
    p = size / (size + max(mean - 1, 1e-9))
    d = np.arange(dmax)
    logs = np.array([math.lgamma(x + size) - math.lgamma(size) - math.lgamma(x + 1) for x in d]) + size * math.log(p) + d * math.log1p(-p)
    out = np.exp(logs)
    out[-1] = max(0.0, 1 - out[:-1].sum())
    return out


def fit_negative_binomial(durations: np.ndarray, counts: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """mean and size that make observed durations, and censored ones as lower bounds, likeliest: a grid that is refined."""
    longest = int(durations.max())
    best, centre = (-np.inf, 1.0, 1.0), (math.log(max(1.01, float(np.average(durations, weights=counts)))), 0.0)
    for width in (3.0, 1.0, 0.3, 0.1, 0.03):
        for m in np.exp(centre[0] + np.linspace(-width, width, 9)):
            for s in np.exp(centre[1] + np.linspace(-width, width, 9)):
                pmf = negative_binomial(max(m, 1.0001), s, longest + 1)
                tail = np.maximum(1 - np.concatenate(([0.0], np.cumsum(pmf)[:-1])), 1e-300)
                value = (counts * np.where(censored, np.log(tail[durations - 1]), np.log(np.maximum(pmf[durations - 1], 1e-300)))).sum()
                best = max(best, (float(value), float(m), float(s)))
        centre = (math.log(best[1]), math.log(best[2]))
    return best[1], best[2]


def duration_counts(runs: DataFrame) -> DataFrame:
    """phase, duration, is_censored, n: all that fitting durations needs; a segment is censored unless both its ends were seen."""
    return runs.groupBy("phase", "duration", (F.col("censoring") != "OBSERVED").alias("is_censored")).agg(F.count(F.lit(1)).alias("n"))


def empirical_durations(runs: DataFrame, dmax: int, epsilon: float = 1e-3, n: int = N_PHASES) -> DataFrame:
    """phase, d, p, available: shares of observed durations up to dmax with epsilon added; uniform where none was observed."""
    seen = runs.filter("censoring = 'OBSERVED'").select("phase", F.least("duration", F.lit(dmax)).alias("d")).groupBy("phase", "d").agg(F.count(F.lit(1)).alias("k"))
    grid = runs.sparkSession.range(n * dmax).select(F.floor(F.col("id") / dmax).alias("phase"), (F.col("id") % dmax + 1).alias("d"))
    rows = grid.join(F.broadcast(seen), ["phase", "d"], "left").na.fill(0, ["k"])
    own = W.partitionBy("phase")
    some = F.sum("k").over(own) > 0
    p = F.when(some, (F.col("k") + epsilon) / (F.sum("k").over(own) + dmax * epsilon)).otherwise(F.lit(1.0 / dmax))
    return rows.select("phase", "d", p.alias("p"), some.cast("long").alias("available"))


def expected_duration(durations: DataFrame) -> DataFrame:
    """phase, expected, q50, q90: mean and quantiles of a duration table (phase, d, p)."""
    cdf = F.sum("p").over(W.partitionBy("phase").orderBy("d")) / F.sum("p").over(W.partitionBy("phase"))
    rows = durations.withColumn("cdf", cdf)
    return rows.groupBy("phase").agg((F.sum(F.col("d") * F.col("p")) / F.sum("p")).alias("expected"), F.min(F.when(F.col("cdf") >= 0.5 - 1e-12, F.col("d"))).alias("q50"), F.min(F.when(F.col("cdf") >= 0.9 - 1e-12, F.col("d"))).alias("q90"))


def forward_in_sql(series: DataFrame, pi: DataFrame, a: DataFrame) -> DataFrame:
    """video, frame, state, p of (video, frame, emission): filtering with array functions alone, as one fold over each video's ordered rows."""
    start = pi.agg(F.transform(F.array_sort(F.collect_list(F.struct("phase", "p"))), lambda x: x["p"]).alias("pi"))
    rows_of = a.groupBy(F.col("b").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "p"))), lambda x: x["p"]).alias("from"))
    table = rows_of.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "from"))), lambda x: x["from"]).alias("into"))
    ordered = series.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", "emission"))).alias("seq"))
    both = ordered.join(F.broadcast(start)).join(F.broadcast(table))

    def once(x, f):
        """f of a value that is computed once, however often f names it."""
        return F.transform(F.array(x), f)[0]

    def normal(x):
        return once(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(x, lambda v: v / total))

    def step(acc, row):
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)["p"])
        ahead = once(before, lambda p: F.when(p.isNull(), F.col("pi")).otherwise(F.transform(F.col("into"), lambda col: F.aggregate(F.zip_with(p, col, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v))))
        seen = once(F.array_max(row["emission"]), lambda top: F.zip_with(ahead, row["emission"], lambda x, e: x * F.exp(e - top)))
        return F.concat(acc, F.array(F.struct(row["frame"].alias("frame"), once(seen, normal).alias("p"))))

    empty = F.array().cast("array<struct<frame:bigint,p:array<double>>>")
    folded = both.select("video", F.explode(F.aggregate("seq", empty, step)).alias("x"))
    best = F.array_max("x.p")
    return folded.select("video", F.col("x.frame").alias("frame"), (F.array_position("x.p", best) - 1).alias("state"), best.alias("p"))


def parameters(series: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """log_pi and log_a of the hidden-Markov model of a series; tables of fixed size come to the driver. Its matrix lets phases follow themselves: `semimarkov.fit` makes the other model's own."""
    return log_table(initial_distribution(series)), log_table(transition_probabilities(series, segments(series)))


def causal_filter(batches: Iterator[pd.DataFrame], state: tuple | None, log_pi: np.ndarray, log_a: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Filters new rows of one video from a saved posterior: what a streaming job keeps between batches is one vector."""
    out, own = [], None if state is None else np.array(state[0])
    for rows in batches:
        rows = rows.sort_values("frame")
        b = np.stack(rows["emission"].to_numpy()).astype(float) if len(rows) else np.zeros((0, len(log_pi)))
        best = []
        for t in range(len(b)):
            x = b[t] + (log_pi if own is None else _logsumexp(own[:, None] + log_a, axis=0))
            own = x - _logsumexp(x)
            best.append(int(own.argmax()))
        out.append(pd.DataFrame({"video": rows["video"].to_numpy(), "frame": rows["frame"].to_numpy(), "state": best}))
    return pd.concat(out) if out else pd.DataFrame({"video": [], "frame": [], "state": []}), own
