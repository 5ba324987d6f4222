"""Runs and experiments: summaries, comparability, graded scores, changes of verdict, differences of JSON trees."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_summary(answers: DataFrame, run: str, text: str, grounded: Column | None = None, elapsed: Column | None = None) -> DataFrame:
    """run, n, n_empty, mean and largest length of the answers; with `grounded` n_grounded, with `elapsed` its sum and largest value, nulls aside."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    more = [] if grounded is None else [F.count_if(grounded).alias("n_grounded")]
    more += [] if elapsed is None else [F.sum(elapsed).alias("elapsed_total"), F.max(elapsed).alias("elapsed_max")]
    return answers.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count_if(size == 0).alias("n_empty"), F.avg(size).alias("mean_length"), F.max(size).alias("max_length"), *more)


def comparability(runs: DataFrame, run: str, settings: list[str]) -> DataFrame:
    """run, setting, n_values, comparable: runs are comparable if a setting has one value in them."""
    each = runs.select(run, F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.col(s).cast("string").alias("value")) for s in settings])).alias("x")).select(run, "x.*")
    return each.groupBy(run, "setting").agg(F.count_distinct("value").alias("n_values")).withColumn("comparable", (F.col("n_values") <= 1).cast("long"))


def points(grade: Column) -> Column:
    return F.when(grade == "PASS", 1.0).when(grade == "PARTIAL", 0.5).when(grade == "FAIL", 0.0)


def graded(answers: DataFrame) -> DataFrame:
    """condition, n, total, mean, std (sample) of per-question means, best: the condition of highest mean, ties to the first by name."""
    per = answers.groupBy("condition", "question").agg(F.sum(points(F.col("grade"))).alias("total"), F.avg(points(F.col("grade"))).alias("mean"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy("condition").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"))
    top = out.agg(F.min(F.struct((-F.round("mean", 9)).alias("m"), "condition"))["condition"].alias("_best"))
    return out.join(F.broadcast(top)).withColumn("best", (F.col("condition") == F.col("_best")).cast("long")).drop("_best")


def verdict_changes(rows: DataFrame) -> DataFrame:
    """freed, tightened, still_flagged and n of (before, after) flags."""
    b, a = F.col("before"), F.col("after")
    return rows.agg(F.count_if(b & ~a).alias("freed"), F.count_if(~b & a).alias("tightened"), F.count_if(b & a).alias("still_flagged"), F.count(F.lit(1)).alias("n"))


def leaves(value, path: str = "") -> list[tuple[str, str]]:
    """(path, value as JSON) of every leaf of a parsed JSON tree, keys in order."""
    if isinstance(value, dict) and value:
        return [x for k in sorted(value) for x in leaves(value[k], f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
    return [(path, json.dumps(value, ensure_ascii=False))]


def json_leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value of every leaf of JSON texts; texts that are no JSON, and null ones, give one leaf without path. Texts come in Arrow batches."""

    def tree(text):
        try:
            return [{"path": p, "value": v} for p, v in leaves(json.loads(text))]
        except (TypeError, ValueError):
            return [{"path": "", "value": text}]

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series([tree(t) for t in texts], dtype=object)

    return rows.select(key, F.explode(walk(F.col(column))).alias("x")).select(key, "x.*")


def json_diff(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, left, right of the leaves in which two JSON texts of one key differ; `<absent>` where one side has none."""
    a = json_leaves(left, key, column).withColumnRenamed("value", "left")
    b = json_leaves(right, key, column).withColumnRenamed("value", "right")
    both = a.join(b, [key, "path"], "full_outer").na.fill("<absent>", ["left", "right"])
    return both.filter("left <> right")


def canonical_hash(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, hash of JSON texts by their sorted leaves, so that key order and spaces do not matter."""
    each = json_leaves(rows, key, column)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: F.concat_ws("=", x["path"], x["value"])), "\n")
    return each.groupBy(key).agg(F.sha2(text, 256).alias("hash"))


def forbidden(rows: DataFrame, key: str, column: str, keys: list[str]) -> DataFrame:
    """key, path of leaves below a key that must not be there."""
    pattern = r"(^|[.\]])(" + "|".join(keys) + r")($|[.\[])"
    return json_leaves(rows, key, column).filter(F.rlike("path", F.lit(pattern))).select(key, "path")


def summarised(numbers: Column) -> Column:
    """A list of whole numbers as `first..last` if it has no gap, else joined by commas."""
    first, last = F.element_at(numbers, 1), F.element_at(numbers, -1)
    run = (F.size(numbers) > 2) & (last - first == F.size(numbers) - 1) & (numbers == F.sequence(first, last))
    return F.when(F.size(numbers) == 0, "").when(run, F.concat(first.cast("string"), F.lit(".."), last.cast("string"))).otherwise(F.array_join(numbers.cast("array<string>"), ","))
