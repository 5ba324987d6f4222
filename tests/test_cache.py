"""The result cache: hits, misses by each of the five fields, failures of one key, recorded order, unfinished builds."""

import pytest
from pyspark.sql import functions as F

from phaseloom.sources.cache import FIELDS, ResultCache

SCHEMA = "video long, frame long, twice double"


@pytest.fixture
def series(spark):
    return spark.createDataFrame([(v, f, float(v * f)) for v in (3, 1, 2) for f in range(1, 5)], "video long, frame long, value double")


def twice(rows):
    return rows.sort_values("frame").assign(twice=2 * rows["value"])


def statuses(df):
    return {r.video: (r.status, r.error) for r in df.collect()}


def test_results_are_built_once(spark, series, tmp_path):
    cache = ResultCache(spark, str(tmp_path), "m", "1", SCHEMA)
    assert statuses(cache.warm(series, F.lit("val"), twice)) == {v: ("built", None) for v in (1, 2, 3)}
    assert statuses(cache.warm(series, F.lit("val"), lambda rows: 1 / 0)) == {v: ("hit", None) for v in (1, 2, 3)}
    rows = [tuple(r) for r in cache.read(cache.wanted(series, F.lit("val")), ("frame",)).collect()]
    assert rows == [(v, f, 2.0 * v * f) for v in (1, 2, 3) for f in range(1, 5)]
    assert ResultCache(spark, str(tmp_path / "none"), "m", "1", SCHEMA).read(cache.wanted(series, F.lit("val"))).count() == 0


@pytest.mark.parametrize("field", FIELDS)
def test_each_field_invalidates(spark, series, tmp_path, field):
    cache = ResultCache(spark, str(tmp_path), "m", "1", SCHEMA)
    cache.warm(series, F.lit("val"), twice)
    split, other, rows = "val", cache, series
    if field.startswith("model"):
        other = ResultCache(spark, str(tmp_path), *(("n", "1") if field == "model_name" else ("m", "2")), SCHEMA)
    elif field == "split":
        split = "train"
    elif field == "video":
        rows = series.withColumn("video", F.when(F.col("video") == 2, 9).otherwise(F.col("video")).cast("long"))
    else:
        rows = series.filter("not (video = 2 and frame = 4)")
    missing = {r.video for r in other.missing(other.wanted(rows, F.lit(split))).collect()}
    assert missing == ({9} if field == "video" else {2} if field == "fingerprint" else {1, 2, 3})
    got = statuses(other.warm(rows, F.lit(split), twice))
    assert {v for v, (s, _) in got.items() if s == "built"} == missing
    kept = other.read(other.wanted(rows, F.lit(split)))
    assert kept.count() == rows.count() and cache.read(cache.wanted(series, F.lit("val"))).count() == (8 if field == "fingerprint" else 12)


def test_a_failure_is_one_video_s(spark, series, tmp_path):
    cache = ResultCache(spark, str(tmp_path), "m", "1", SCHEMA)

    def picky(rows):
        if rows["video"].iloc[0] == 2:
            raise ValueError("no such thing")
        return twice(rows)

    assert statuses(cache.warm(series, F.lit("val"), picky)) == {1: ("built", None), 2: ("failed", "ValueError: no such thing"), 3: ("built", None)}
    wanted = cache.wanted(series, F.lit("val"))
    assert {r.video for r in cache.missing(wanted).collect()} == {2} and cache.read(wanted).count() == 8
    assert statuses(cache.warm(series, F.lit("val"), twice)) == {1: ("hit", None), 2: ("built", None), 3: ("hit", None)}
    assert [r.video for r in cache.read(wanted, ("frame",)).collect()] == [1] * 4 + [2] * 4 + [3] * 4


def test_data_without_entries_is_not_read(spark, series, tmp_path):
    cache = ResultCache(spark, str(tmp_path), "m", "1", SCHEMA)
    series.withColumn("twice", F.lit(0.0)).select("video", "frame", "twice").withColumn("build", F.lit("lost")).write.partitionBy("build").parquet(f"{tmp_path}/data")
    wanted = cache.wanted(series, F.lit("val"))
    assert cache.read(wanted).count() == 0 and cache.missing(wanted).count() == 3
    cache.warm(series, F.lit("val"), twice)
    assert cache.read(wanted).agg(F.sum("twice")).first()[0] == 2 * sum(v * f for v in (1, 2, 3) for f in range(1, 5))


def test_another_order_is_refused(spark, series, tmp_path):
    class Reversed(ResultCache):
        def wanted(self, rows, split):
            return super().wanted(rows, split).withColumn("place", -F.col("place"))

    ResultCache(spark, str(tmp_path), "m", "1", SCHEMA).warm(series, F.lit("val"), twice)
    with pytest.raises(ValueError):
        Reversed(spark, str(tmp_path), "m", "1", SCHEMA).warm(series, F.lit("val"), twice)
    assert ResultCache(spark, str(tmp_path / "x"), "m", "1", SCHEMA).warm(series.limit(0), F.lit("val"), twice).count() == 0
