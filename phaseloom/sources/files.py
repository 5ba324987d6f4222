"""Files as tables: annotations, splits, listings, vectors with manifests, results kept by key, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATIONS = "phase string, frame_start int, frame_end int"
SPLITS = "Video_name string, Path string, Phase string, Identifier string, Focal string, UsedFor string"
#: Fields in which two builds must agree before one resumes the other.
MANIFEST = ("model", "checkpoint", "window_size", "stride", "focal", "image_size", "mode", "version")


def read_annotations(spark: SparkSession, pattern: str) -> DataFrame:
    """video, phase, frame_start, frame_end, range_no of header-less files `<video>_phases.csv`; range_no is the line's place in its file.

    The phase tHB is not part of the scale and is dropped; lines without phase stay, with a null. A file of ranges is small, so each is read whole and
    split into lines, which keeps their order. Blank lines count as places but give no row; numbers that are none are null.
    """
    files = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = files.select(F.regexp_replace("file", r"_phases\.csv$", "").alias("video"), F.posexplode(F.split("value", "\r?\n")).alias("range_no", "line")).filter(F.trim("line") != "")
    own = F.from_csv("line", ANNOTATIONS, {"mode": "PERMISSIVE"})
    rows = lines.select("video", own.alias("x"), F.col("range_no").cast("long").alias("range_no"))
    return rows.filter(F.coalesce(F.col("x.phase") != "tHB", F.lit(True))).select("video", "x.phase", "x.frame_start", "x.frame_end", "range_no")


def read_split(spark: SparkSession, path: str, used_for: str | None = None) -> DataFrame:
    """Frame rows of a split file, with frame_no from the last number block of the identifier."""
    rows = spark.read.schema(SPLITS).option("header", True).csv(path)
    rows = rows.withColumn("frame_no", F.nullif(F.regexp_extract("Identifier", r"(\d+)[^_]*$", 1), F.lit("")).cast("long"))
    return rows if used_for is None else rows.filter(F.col("UsedFor") == used_for)


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name, folder, frame_no of files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("long").alias("frame_no"))


def existing(rows: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Rows whose file exists."""
    return rows.join(files.select(F.col("name").alias(name)), name, "left_semi")


def missing(rows: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Rows whose file does not exist; nothing is deleted."""
    return rows.join(files.select(F.col("name").alias(name)), name, "left_anti")


def duplicate_folders(files: DataFrame) -> DataFrame:
    """Pairs of folders that share file names, and how many: folder, other, n_shared. Names that all folders use should be filtered first."""
    a = files.select("folder", "name")
    b = files.select(F.col("folder").alias("other"), "name")
    return a.join(b, "name").filter("folder < other").groupBy("folder", "other").agg(F.count(F.lit(1)).alias("n_shared"))


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """name, text of whole files."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def read_json(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """One row for each JSON file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(pattern)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def mismatches(a: dict, b: dict, fields: tuple[str, ...] = MANIFEST) -> list[str]:
    """Fields in which two manifests differ; a missing field equals a null one."""
    return [f for f in fields if a.get(f) != b.get(f)]


def build_missing(wanted: DataFrame, path: str, key: str, build, manifest: dict) -> int:
    """Builds what a table by key lacks and appends it; returns how many keys it built.

    `build` maps rows of missing keys to rows to write. Resuming under another manifest is refused. Spark's committer makes
    each append visible as a whole; keys that failed are simply missing again next time.
    """
    spark = wanted.sparkSession
    try:
        done = spark.read.parquet(f"{path}/data")
        differs = mismatches(read_manifest(spark, f"{path}/manifest"), manifest)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        write_manifest(spark, f"{path}/manifest", manifest)
        done, differs = None, []
    if differs:
        raise ValueError(f"built with other settings: {', '.join(differs)}")
    todo = wanted if done is None else wanted.join(done.select(key).distinct(), key, "left_anti")
    n = todo.select(key).distinct().count()
    if n:
        build(todo).write.mode("append").parquet(f"{path}/data")
    return n


def upsert(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the key's partitions of a table that is partitioned by it; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def remove(spark: SparkSession, path: str, out: str, condition: Column) -> None:
    """A copy of a table without the rows of a condition; the caller puts it in place."""
    spark.read.parquet(path).filter(~condition).write.mode("overwrite").parquet(out)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more rows than `most` are refused, as reports are for reading."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query in another database."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def save_model(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], settings: dict | None = None) -> None:
    """A model's tables of parameters as Parquet folders below `path`, then its kind, settings and the tables' names as JSON; a model without that JSON was not saved to its end."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    about = json.dumps({"kind": kind, "settings": settings or {}, "tables": sorted(tables)}, sort_keys=True)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, settings) of a saved model; one of another kind is refused."""
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    if about["kind"] != kind:
        raise ValueError(f"{path} holds a model of kind {about['kind']}, not {kind}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in about["tables"]}, about["settings"]
