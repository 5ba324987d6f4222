"""Scores of probabilistic predictions: classification, ranking, calibration, resampling and paired tests as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators.sampling import running_total

#: Edges of ten equal bins as a running multiple of 0.1, so that 0.30000000000000004 is the fourth.
EDGES = tuple(i * 0.1 for i in range(11))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(preds: DataFrame, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 at p >= 0.5 (0 where undefined), rates and n of (prob, label), weighted, over all rows or by keys."""
    w = F.lit(1) if weight is None else weight
    said, true = F.col("prob") >= 0.5, F.col("label") == 1

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0))

    sums = preds.groupBy(*(by or [])).agg(total(said & true).alias("tp"), total(said & ~true).alias("fp"), total(~said & true).alias("fn"), total(~said & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return sums.select(
        *(by or []), n.cast("long").alias("n"), ratio(tp + tn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + fn, n).alias("positive_rate"), ratio(tp + fp, n).alias("predicted_rate"),
    )


def _by_score(preds: DataFrame, keys: list[str], weight: Column | None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return preds.groupBy(*keys, "prob").agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, w).otherwise(0)).alias("neg"))


def auroc(preds: DataFrame, keys: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties at half, of (prob, label); null if a class is missing.

    Rows become one for each distinct score before anything is ordered; running counts are kept within blocks of scores and
    over blocks, so no task sees all scores.
    """
    keys = keys or []
    scores = _by_score(preds, keys, weight).withColumn("_block", F.floor(F.col("prob") * 256))
    blocks = scores.groupBy(*keys, "_block").agg(F.sum("neg").alias("_neg"))
    below = F.coalesce(F.sum("_neg").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_below", below).drop("_neg").withColumnsRenamed({k: f"_{k}" for k in keys} | {"_block": "_own"})
    same = F.col("_block") == F.col("_own")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = W.partitionBy(*keys, "_block").orderBy("prob").rowsBetween(W.unboundedPreceding, -1)
    rows = scores.join(blocks, same).withColumn("under", F.col("_below") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    won = F.sum(F.col("pos") * (F.col("under") + 0.5 * F.col("neg")))
    pairs = F.sum("pos") * F.sum("neg")
    return rows.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias("auroc"))


def average_precision(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Step-wise area under precision and recall over distinct scores of (prob, label); null without positives."""
    keys = keys or []
    scores = _by_score(preds, keys, None).withColumn("_block", F.floor(F.col("prob") * 256))
    blocks = scores.groupBy(*keys, "_block").agg(F.sum("pos").alias("_p"), F.sum(F.col("pos") + F.col("neg")).alias("_n"))
    above = W.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_own"), F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_na"))
    same = F.col("_block") == F.col("_own")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = W.partitionBy(*keys, "_block").orderBy(F.desc("prob")).rowsBetween(W.unboundedPreceding, 0)
    rows = scores.join(blocks, same).withColumn("hits", F.col("_pa") + F.sum("pos").over(inside)).withColumn("seen", F.col("_na") + F.sum(F.col("pos") + F.col("neg")).over(inside))
    return rows.groupBy(*keys).agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("hits") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def log_loss(preds: DataFrame, clip: float = 1e-7) -> DataFrame:
    """Mean negative log-likelihood of (prob, label) with probabilities kept `clip` away from 0 and 1."""
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - clip)), F.lit(clip))
    return preds.agg(F.avg(-F.ln(F.when(F.col("label") == 1, p).otherwise(1 - p))).alias("log_loss"))


def one_against_rest(preds: DataFrame, classes: int) -> DataFrame:
    """class, support, auroc of (probs: array, truth: place in it): each class against all others; auroc is null for a class that no row or every row has."""
    each = preds.select("truth", F.posexplode("probs").alias("class", "prob")).filter(F.col("class") < classes)
    rows = each.select("class", "prob", (F.col("truth") == F.col("class")).cast("long").alias("label"))
    support = rows.groupBy("class").agg(F.sum("label").alias("support"))
    return support.join(auroc(rows, ["class"]), "class")


def ranking_summary(preds: DataFrame, classes: int, clip: float = 1e-7) -> DataFrame:
    """macro_auroc, weighted_auroc (by support), log_loss, accuracy, n of (probs, truth).

    Means leave out classes without an area. For the log loss probabilities are kept `clip` away from 0 and 1, then made to sum to 1. The first of the
    likeliest classes is the prediction.
    """
    per = one_against_rest(preds, classes).filter("auroc is not null")
    areas = per.agg(F.avg("auroc").alias("macro_auroc"), (F.sum(F.col("auroc") * F.col("support")) / F.sum("support")).alias("weighted_auroc"))
    kept = F.transform("probs", lambda p: F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip)))
    total = F.aggregate(kept, F.lit(0.0), lambda s, p: s + p)
    hit = (F.array_position("probs", F.array_max("probs")) - 1 == F.col("truth")).cast("double")
    rest = preds.agg(F.avg(-F.ln(F.get(kept, F.col("truth").cast("int")) / total)).alias("log_loss"), F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return areas.join(rest)


def class_areas(preds: DataFrame, classes: int) -> DataFrame:
    """class, support, auroc, average_precision of (probs, truth): each class against all others; both areas are null for a class that no row or every row has."""
    each = preds.select("truth", F.posexplode("probs").alias("class", "prob")).filter(F.col("class") < classes)
    rows = each.select("class", "prob", (F.col("truth") == F.col("class")).cast("long").alias("label"))
    out = one_against_rest(preds, classes).join(average_precision(rows, ["class"]), "class")
    return out.select("class", "support", "auroc", F.when(F.col("auroc").isNotNull(), F.col("average_precision")).alias("average_precision"))


def multiclass_scores(preds: DataFrame, classes: int, clip: float = 1e-12) -> DataFrame:
    """One row of (probs, truth): macro and support-weighted areas, brier, log_loss, ece, accuracy, n.

    Means leave out classes without an area. Brier sums squared gaps over the classes. For the log loss probabilities are raised to `clip`,
    then made to sum to 1. The calibration error is that of the largest probability, the first of equal ones, in ten bins.
    """
    areas = class_areas(preds, classes).filter("auroc is not null")
    weighted = {name: (F.sum(F.col(area) * F.col("support")) / F.sum("support")).alias(f"weighted_{name}") for name, area in (("auroc", "auroc"), ("ap", "average_precision"))}
    means = areas.agg(F.avg("auroc").alias("macro_auroc"), weighted["auroc"], F.avg("average_precision").alias("macro_ap"), weighted["ap"])
    kept = F.transform("probs", lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(clip)))
    total = F.aggregate(kept, F.lit(0.0), lambda s, p: s + p)
    gaps = F.transform("probs", lambda p, k: F.pow(p - (F.col("truth") == k).cast("double"), F.lit(2)))
    hit = (F.array_position("probs", F.array_max("probs")) - 1 == F.col("truth")).cast("long")
    rest = preds.agg(
        F.avg(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)).alias("brier"), F.avg(-F.ln(F.get(kept, F.col("truth").cast("int")) / total)).alias("log_loss"),
        F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"),
    )
    return means.join(rest).join(ece(calibration_bins(preds.select(F.array_max("probs").alias("prob"), hit.alias("label")))))


def brier(preds: DataFrame) -> DataFrame:
    """Brier score of (prob, label), that of the constant rate, and n."""
    rate = F.avg(F.col("label").cast("double"))
    return preds.agg(F.avg(F.pow(F.col("prob") - F.col("label"), F.lit(2))).alias("brier"), (rate * (1 - rate)).alias("brier_constant"), F.count(F.lit(1)).alias("n"))


def bin_of(p: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """The bin of a probability by comparison with the edges; the last bin is closed on both sides."""
    out = F.lit(0)
    for k, edge in enumerate(edges[1:-1], 1):
        out = F.when(p >= edge, k).otherwise(out)
    return out.cast("long")


def calibration_bins(preds: DataFrame, keys: list[str] | None = None, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """bin, low, high, n, mean_predicted, mean_observed for every bin, empty ones with null means (with keys: those that occur)."""
    keys = keys or []
    found = preds.groupBy(*keys, bin_of(F.col("prob"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_predicted"), F.avg(F.col("label").cast("double")).alias("mean_observed"))
    bins = preds.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1)], "bin long, low double, high double")
    if keys:
        return found.join(F.broadcast(bins), "bin").select(*keys, "bin", "low", "high", "n", "mean_predicted", "mean_observed")
    return bins.join(found, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "mean_observed")


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error: the bins' gaps between predicted and observed, weighted by their rows."""
    gap = F.abs(F.col("mean_predicted") - F.col("mean_observed"))
    return bins.filter("n > 0").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def murphy(bins: DataFrame) -> DataFrame:
    """reliability, resolution, uncertainty and their sum with signs, from calibration bins."""
    total = bins.filter("n > 0").agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean_observed")) / F.sum("n")).alias("rate"))
    rows = bins.filter("n > 0").join(F.broadcast(total))
    out = rows.agg(
        (F.sum(F.col("n") * F.pow(F.col("mean_predicted") - F.col("mean_observed"), F.lit(2))) / F.first("all_n")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("mean_observed") - F.col("rate"), F.lit(2))) / F.first("all_n")).alias("resolution"),
        (F.first("rate") * (1 - F.first("rate"))).alias("uncertainty"),
    )
    return out.withColumn("decomposed", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


def per_phase(preds: DataFrame) -> DataFrame:
    """phase, n, observed, predicted, brier, bias of (phase, prob, label)."""
    return preds.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("observed"), F.avg("prob").alias("predicted"),
        F.avg(F.pow(F.col("prob") - F.col("label"), F.lit(2))).alias("brier"), (F.avg("prob") - F.avg(F.col("label").cast("double"))).alias("bias"),
    )


def confusion(preds: DataFrame, top: int = 4) -> DataFrame:
    """The most frequent confusions of (actual, predicted): n, share of the actual class, rank; ties by class."""
    counts = preds.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("actual"))).filter("actual <> predicted")
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "actual", "predicted")).cast("long")).filter(F.col("rank") <= top)


def class_metrics(preds: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of every class of (actual, predicted)."""
    rows = preds.select(F.explode(F.array(F.struct(F.col("actual").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("actual") == F.col("predicted")).cast("int").alias("h")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    out = rows.groupBy(F.col("c").alias("class")).agg(F.sum("a").alias("support"), F.sum("p").alias("said"), F.sum("h").alias("hits"))
    return out.select("class", "support", ratio(F.col("hits"), F.col("said")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("said") + F.col("support")).alias("f1"))


def multiclass_summary(preds: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy (mean recall of classes that occur), macro and support-weighted f1."""
    own = class_metrics(preds)
    n = F.sum("support")
    return own.agg(
        (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
    )


def class_weights(rows: DataFrame, column: str, alpha: float = 1.0) -> DataFrame:
    """(N / (K * n)) ^ alpha for each class."""
    counts = rows.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy()
    return counts.select("class", "n", F.pow(F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")), F.lit(alpha)).alias("weight"))


def bootstrap_weights(groups: DataFrame, key: str, resamples: int, salt: str = "boot") -> DataFrame:
    """resample_id, key, multiplicity: as many draws as there are groups, with replacement, by a hash of resample and draw.

    Draw d of resample r takes the group whose place is the hash of (r, d) modulo the number of groups, so SQL can draw the same.
    """
    placed = running_total(groups.select(key).distinct(), F.col(key), F.lit(1), "_place")
    n = placed.count()
    draws = groups.sparkSession.range(resamples * max(n, 1)).select(F.floor(F.col("id") / max(n, 1)).alias("resample_id"), (F.col("id") % max(n, 1)).alias("draw"))
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), "resample_id", "draw").cast("binary")), 1, 12), 16, 10).cast("long")
    drawn = draws.groupBy("resample_id", (code % max(n, 1)).alias("_place")).agg(F.count(F.lit(1)).alias("multiplicity"))
    return drawn.join(placed, "_place").select("resample_id", key, "multiplicity")


def bootstrap_metric(preds: DataFrame, key: str, resamples: int, salt: str = "boot") -> DataFrame:
    """resample_id, auroc, accuracy of resamples of whole groups: predictions are made once and weighted by how often their group was drawn."""
    drawn = preds.join(bootstrap_weights(preds, key, resamples, salt), key)
    weight = F.col("multiplicity")
    return auroc(drawn, ["resample_id"], weight).join(binary_metrics(drawn, weight, ["resample_id"]).select("resample_id", "accuracy"), "resample_id")


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """mean, std (sample), low and high (linear percentiles) and n of a column, nulls aside."""
    tail = (1 - level) / 2
    cut = F.percentile(column, F.array(F.lit(tail), F.lit(1 - tail)))
    return values.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), cut.alias("_c"), F.count(column).alias("n")).select("mean", "std", F.col("_c")[0].alias("low"), F.col("_c")[1].alias("high"), "n")


def paired_difference(rows: DataFrame) -> DataFrame:
    """Of (a, b) pairs: mean and sample deviation of b - a, percentile interval, effect size (null without spread), signed-rank sums W+ and W- with mean ranks of ties, n of non-zero differences and the tie term of wilcoxon_p."""
    diff = rows.select((F.col("b") - F.col("a")).alias("d")).filter("d is not null")
    cut = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    facts = diff.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), cut.alias("c"))
    size = diff.filter("d <> 0").withColumn("m", F.round(F.abs("d"), 12)).groupBy("m").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    ranks = running_total(size, F.col("m"), F.col("k"), "below").withColumn("rank", F.col("below") + (F.col("k") + 1) / 2).agg(
        F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("k") - F.col("up"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_nonzero"), F.coalesce(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")), F.lit(0)).alias("tie_term"),
    )
    out = facts.join(F.broadcast(ranks))
    return out.select("mean", "std", F.col("c")[0].alias("low"), F.col("c")[1].alias("high"), F.when(F.col("std") > 0, F.col("mean") / F.col("std")).alias("cohen_d"), "w_plus", "w_minus", "n_nonzero", "tie_term")


def wilcoxon_p(w_plus: float, w_minus: float, n: int, all_close: bool = False, tie_term: float = 0.0) -> float:
    """Two-sided p of the signed-rank test of n non-zero differences; 1 where nothing differs.

    Exact up to 50 differences without ties, else by the normal approximation, whose variance loses tie_term / 48, where tie_term
    sums k^3 - k over groups of k equal sizes.
    """
    if all_close or n == 0:
        return 1.0
    least = min(w_plus, w_minus)
    if n <= 50 and not tie_term:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for total in range(len(ways) - 1, rank - 1, -1):
                ways[total] += ways[total - rank]
        return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return math.erfc(abs(least - mean) / math.sqrt(var) / math.sqrt(2))


def _beyond_stirling(n: int) -> float:
    """ln n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - math.log(2 * math.pi) / 2
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def sign_test_p(wins: int, losses: int) -> float:
    """Two-sided p of a sign test: exact fractions of up to 1,000 signs, else the same sum in doubles, from its largest term down to those that no longer count."""
    n, k = wins + losses, min(wins, losses)
    if n <= 1000 or k == 0:
        return min(1.0, 2 * (sum(math.comb(n, i) for i in range(k + 1)) / 2**n if k else math.ldexp(1.0, -n))) if n else 1.0
    # The largest term by Stirling's formula; what differs from an even split goes through log1p, so nothing is lost where it is small.
    d = (n - 2 * k) / n
    apart = n / 2 * ((1 - d) * math.log1p(-d) + (1 + d) * math.log1p(d))
    term = math.sqrt(n / (2 * math.pi * k * (n - k))) * math.exp(_beyond_stirling(n) - _beyond_stirling(k) - _beyond_stirling(n - k) - apart)
    total = 0.0
    while k >= 0 and term > total * 1e-18:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * total)


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on a numerically integrated density; for intervals of a few repetitions."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def tail(x: float, steps: int = 2000) -> float:
        h = x / steps
        f = [scale * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps + 1)]
        return 0.5 + h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    low, high = 0.0, 1e3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) < p else (low, mid)
    return low


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """test, p_value, rank, threshold, rejected: step-down, stopping at the first test that is not rejected."""
    whole, order = W.partitionBy(), W.orderBy("p_value", "test")
    rows = tests.withColumn("rank", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("threshold", F.lit(alpha) / (F.count(F.lit(1)).over(whole) - F.col("rank") + 1))
    passed = F.min((F.col("p_value") <= F.col("threshold")).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("test", "p_value", "rank", "threshold", passed.alias("rejected"))


def average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ranks from 1, ties at their mean rank; ranks are counted over distinct values, within blocks of values and over blocks."""
    values = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_k"))
    ranks = running_total(values, F.col(column), F.col("_k"), "_under").select(column, (F.col("_under") + (F.col("_k") + 1) / 2).alias(name))
    return rows.join(ranks, column)


def correlations(rows: DataFrame) -> DataFrame:
    """Of (x, y, z): Pearson and Spearman of x and y, the partial correlation given z, and a 95 % interval by Fisher's z."""
    ranked = average_rank(average_rank(rows, "x", "rx"), "y", "ry")
    sums = ranked.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.corr("x", "z").alias("xz"), F.corr("y", "z").alias("yz"), F.count(F.lit(1)).alias("n"))
    partial = (F.col("pearson") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    half = 1.959963984540054 / F.sqrt(F.col("n") - 3)
    return sums.select("pearson", "spearman", partial.alias("partial"), F.tanh(F.atanh("pearson") - half).alias("low"), F.tanh(F.atanh("pearson") + half).alias("high"), "n")


def select_config(grid: DataFrame, floor: float) -> DataFrame:
    """The grid's configurations (config_no, auroc, brier, accuracy) with rank and chosen: eligible at auroc >= floor, then least Brier (4 places), most auroc, most accuracy, grid order."""
    fit = F.coalesce(F.col("auroc") >= floor, F.lit(False))
    order = W.orderBy(F.desc("_fit"), F.round("brier", 4), F.desc("auroc"), F.desc("accuracy"), "config_no")
    rows = grid.withColumn("_fit", fit.cast("int"))
    rank = F.when(fit, F.row_number().over(order)).cast("long")
    reason = F.when(~fit, "below the auroc floor").when(F.col("rank") == 1, "chosen").otherwise("eligible")
    return rows.withColumn("rank", rank).select("config_no", "auroc", "brier", "accuracy", "rank", reason.alias("reason"))


def category_accuracy(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """n, n_match, accuracy of categories; a null on one side is no match."""
    same = F.col(expected).eqNullSafe(F.col(got))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_match"), F.avg(same.cast("int")).alias("accuracy"))


def outcomes_by_pair(rows: DataFrame, first: str, last: str) -> DataFrame:
    """actual, predicted, is_right, first, last, n: two-class outcomes, told apart by the phases at both ends of a window."""
    right = (F.col("actual") == F.col("predicted")).alias("is_right")
    return rows.groupBy("actual", "predicted", right, first, last).agg(F.count(F.lit(1)).alias("n"))


def ladder_comparisons(results: DataFrame, pairs: list[tuple[str, str]], metric: str) -> DataFrame:
    """model, baseline, value, baseline_value, gain of listed pairs of models (model, metric); pairs that a side lacks are left out."""
    listed = results.sparkSession.createDataFrame(pairs, "model string, baseline string")
    own = results.select("model", F.col(metric).alias("value"))
    base = results.select(F.col("model").alias("baseline"), F.col(metric).alias("baseline_value"))
    return listed.join(own, "model").join(base, "baseline").select("model", "baseline", "value", "baseline_value", (F.col("value") - F.col("baseline_value")).alias("gain"))


def joined_by_phase(stats: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by phase, with `is_excluded` for phases of `stats` without durations; phases that only have durations are left out."""
    return stats.join(durations.withColumn("_has", F.lit(True)), key, "left").withColumn("is_excluded", F.col("_has").isNull()).drop("_has")


def config_grid(rows: DataFrame, alphas: list[float], rhos: list[float]) -> DataFrame:
    """config_no, alpha, rho, n, brier, accuracy, auroc of every pair of settings over (first, second, label): the score is first ^ alpha, mixed with second by rho.

    Rows are multiplied by the number of settings before they are aggregated, never paired with each other.
    """
    settings = [(i * len(rhos) + j, a, r) for i, a in enumerate(alphas) for j, r in enumerate(rhos)]
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("config_no"), F.lit(a).alias("alpha"), F.lit(r).alias("rho")) for n, a, r in settings]))
    scored = rows.select("first", "second", "label", each.alias("s")).select("s.*", "label", ((1 - F.col("s.rho")) * F.pow("first", F.col("s.alpha")) + F.col("s.rho") * F.col("second")).alias("prob"))
    keys = ["config_no", "alpha", "rho"]
    gap = F.col("prob") - F.col("label")
    own = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("brier"), F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("int")).alias("accuracy"))
    return own.join(auroc(scored, keys), keys)
