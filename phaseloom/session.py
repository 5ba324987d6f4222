"""Session, tables, the phase dimension and the guard on evaluation splits."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# The ordered phases of development; a phase's index is its place here.
PHASES = ("tPB2", "tPNa", "tPNf", "t2", "t3", "t4", "t5", "t6", "t7", "t8", "t9+", "tM", "tSB", "tB", "tEB")
SPLITS = ("train", "val", "test")


def local_session(name: str, cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks; jobs on a cluster bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the folder in `spark.checkpoint.dir` and read from there: for small results that many views read. A session on one machine without one gets a temporary folder; on a cluster that is an error."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="phaseloom-checkpoint-"))
    return df.checkpoint()


def phase_table(spark: SparkSession) -> DataFrame:
    """idx, name of every phase."""
    return spark.createDataFrame(list(enumerate(PHASES)), "idx long, name string")


def served_split(split: str) -> str:
    """The split, if it may be served: `test` is kept for final evaluation, other names are unknown."""
    name = split.lower()
    if name == "test":
        raise PermissionError("the test split is not served")
    if name not in SPLITS:
        raise ValueError(f"unknown split {split!r}; known are {', '.join(SPLITS[:2])}")
    return name
