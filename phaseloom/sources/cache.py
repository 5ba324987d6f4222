"""Results kept by key: built once for each video, read again only while everything that they rest on is the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.session import checkpointed

# What a kept result must agree in to be read again; the fingerprint stands for the frames that it was made of.
FIELDS = ("model_name", "model_version", "split", "video", "fingerprint")


def fingerprints(series: DataFrame) -> DataFrame:
    """video, fingerprint: a hash of the video's frame numbers, in order; a series with other frames has another one."""
    return series.groupBy("video").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("frame")).cast("array<string>"), ","), 256).alias("fingerprint"))


def isolated(compute: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]):
    """A function for groups of a video that never fails: rows of `compute` with a null error, or one row that has only the video and the error."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return compute(rows).assign(error=None)[[*columns, "error"]]
        except Exception as error:  # whatever went wrong is this video's result
            return pd.DataFrame([{**dict.fromkeys(columns), "video": rows["video"].iloc[0], "error": f"{type(error).__name__}: {error}"}])[[*columns, "error"]]

    return run


class ResultCache:
    """Tables below a folder that all executors share: `data`, one part for each build, and `entries`, what each build holds.

    A build writes its data first and its entries last, so an entry is visible only when its rows are whole; of several entries of one key the latest counts.
    Nothing is overwritten: a reader of older parts goes on undisturbed. Two builds at one time may both build a key; the later entry counts, and both are right.
    """

    def __init__(self, spark: SparkSession, path: str, model_name: str, model_version: str, schema: str):
        """schema: of the results, with a column `video`."""
        self.spark, self.path, self.schema = spark, path, schema
        self.model = {"model_name": F.lit(model_name), "model_version": F.lit(model_version)}
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The latest entry of each key (model_name, model_version, split, video): its fingerprint, place, build and number."""
        rows = self._read("entries", "model_name string, model_version string, split string, video long, fingerprint string, place long, build string, number long")
        key = [f for f in FIELDS if f != "fingerprint"]
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max(F.struct("number", *[c for c in rest if c != "number"])).alias("e")).select(*key, *[F.col(f"e.{c}").alias(c) for c in rest])

    def wanted(self, series: DataFrame, split: Column) -> DataFrame:
        """One row for each video of a series: the five fields, and place, its rank by id."""
        rows = fingerprints(series).withColumns(self.model | {"split": split})
        return rows.select(*FIELDS, F.col("video").cast("long").alias("place"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Wanted keys without an entry that agrees in all five fields."""
        return wanted.join(self.entries().select(*FIELDS), list(FIELDS), "left_anti")

    def warm(self, series: DataFrame, split: Column, compute: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
        """Builds what is missing, a video in each group, and returns video, status (hit, built or failed), error for each video of the series.

        `compute` turns the rows of one video into rows of the schema. A video that fails has no entry: it stays missing, is tried again next time, and stops no other.
        Keys whose recorded place differs from the wanted one are refused, as their results could not be merged in one order.
        """
        wanted = checkpointed(self.wanted(series, split))
        known = self.entries()
        moved = wanted.alias("w").join(known.alias("k"), [F.col(f"w.{f}") == F.col(f"k.{f}") for f in FIELDS]).filter("w.place <> k.place")
        if not moved.isEmpty():
            raise ValueError("built in another order")
        todo = checkpointed(self.missing(wanted))
        if todo.isEmpty():
            return wanted.select("video", F.lit("hit").alias("status"), F.lit(None).cast("string").alias("error"))
        build, number = uuid.uuid4().hex, (known.agg(F.max("number")).first()[0] or 0) + 1
        rows = series.join(todo.select("video"), "video", "left_semi")
        found = checkpointed(rows.groupBy("video").applyInPandas(isolated(compute, self.columns), f"{self.schema}, error string"))
        failed = found.filter("error is not null").select("video", "error")
        found.filter("error is null").drop("error").withColumn("build", F.lit(build)).write.mode("append").partitionBy("build").parquet(f"{self.path}/data")
        whole = todo.join(failed.select("video"), "video", "left_anti")
        whole.withColumns({"build": F.lit(build), "number": F.lit(number).cast("long")}).write.mode("append").parquet(f"{self.path}/entries")
        own = todo.select("video", F.lit(True).alias("_todo")).join(failed, "video", "left")
        status = F.when(F.col("_todo").isNull(), "hit").when(F.col("error").isNull(), "built").otherwise("failed")
        return wanted.select("video").join(own, "video", "left").select("video", status.alias("status"), "error")

    def read(self, wanted: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
        """Kept rows of the wanted keys that have an entry which agrees in all five fields, in the recorded order of videos, then by `within`."""
        hits = self.entries().join(wanted.select(*FIELDS), list(FIELDS), "left_semi").select("video", "build", "place")
        data = self._read("data", f"{self.schema}, build string")
        return data.join(hits, ["video", "build"]).orderBy("place", *within).select(*self.columns)
