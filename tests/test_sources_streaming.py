import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.operators import hmm, scan, trajectory
from phaseloom.sources import files
from phaseloom.streaming import frames as streams


def test_annotations_and_splits(spark, tmp_path):
    (tmp_path / "Patient_3_phases.csv").write_text("t2,1,4\nt3,5,6\ntHB,7,9\n")
    got = files.read_annotations(spark, f"{tmp_path}/*_phases.csv").orderBy("range_no").collect()
    assert [(r.video, r.phase, r.frame_start, r.frame_end, r.range_no) for r in got] == [("Patient_3", "t2", 1, 4, 0), ("Patient_3", "t3", 5, 6, 1)]
    (tmp_path / "P_phases.csv").write_text("t4,3,9\n\nt3,1,5\n,2,2\n")
    late = files.read_annotations(spark, f"{tmp_path}/P_phases.csv").orderBy("range_no").collect()
    assert [(r.phase, r.frame_start, r.range_no) for r in late] == [("t4", 3, 0), ("t3", 1, 2), (None, 2, 3)]
    frames = spark.createDataFrame([("P", k) for k in range(1, 10)], "video string, frame int")
    named = trajectory.explode_annotations(files.read_annotations(spark, f"{tmp_path}/P_phases.csv"), frames, last_wins=True)
    assert {r.frame: r.range_phase for r in named.collect()} == {1: "t3", 2: None, 3: "t3", 4: "t3", 5: "t3", 6: "t4", 7: "t4", 8: "t4", 9: "t4"}
    (tmp_path / "F0.csv").write_text("Video_name,Path,Phase,Identifier,Focal,UsedFor\nv,p,t2,Patient_3_Image_17,F0,Train\nv,p,t2,Patient_3_Image_18,F0,Val\n")
    assert [r.frame_no for r in files.read_split(spark, f"{tmp_path}/F0.csv", "Train").collect()] == [17]


def test_listing_and_texts(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "RUN_7.jpg").write_bytes(b"x")
    (tmp_path / "a" / "RUN_8.jpg").write_bytes(b"x")
    found = files.listing(spark, str(tmp_path), "*.jpg")
    assert sorted((r.folder, r.frame_no) for r in found.collect()) == [("a", 7), ("a", 8), ("b", 7)]
    assert files.duplicate_folders(found).collect()[0].n_shared == 1
    rows = spark.createDataFrame([("RUN_8.jpg",), ("RUN_9.jpg",)], "file string")
    assert files.existing(rows, found, "file").count() == 1 and files.missing(rows, found, "file").count() == 1
    (tmp_path / "doc.md").write_text("# A\nb")
    assert files.read_texts(spark, f"{tmp_path}/*.md").first().text == "# A\nb"


def test_builds_resume_only_with_the_same_settings(spark, tmp_path):
    path, manifest = f"{tmp_path}/cache", {"model": "m", "window_size": 8}
    wanted = spark.range(5).select(F.col("id").alias("video"))
    double = lambda rows: rows.withColumn("v", F.col("video") * 2)
    assert files.build_missing(wanted.filter("video < 2"), path, "video", double, manifest) == 2
    assert files.build_missing(wanted, path, "video", double, manifest) == 3
    assert files.build_missing(wanted, path, "video", double, manifest) == 0
    assert spark.read.parquet(f"{path}/data").count() == 5
    with pytest.raises(ValueError, match="window_size"):
        files.build_missing(wanted, path, "video", double, manifest | {"window_size": 9})
    assert files.mismatches({"model": "a"}, {"model": "a", "stride": None}) == []


def test_upsert_and_reports(spark, tmp_path):
    path = f"{tmp_path}/store"
    files.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, n int"), path, "document_id")
    files.upsert(spark.createDataFrame([("b", 2)], "document_id string, n int"), path, "document_id")
    assert {(r.document_id, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    assert files.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 |  |"
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), 3)


def test_stream_counts_equal_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.event_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("counts").select("window_start", "event_type", "n").collect()}
    want = {tuple(r) for r in events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("w"), "event_type").count().collect()}
    assert got == want


def test_streamed_filter_equals_batch(spark, tmp_path):
    rows = [(v, i + 1, min(4, i // 3 + v), 1.0) for v in range(2) for i in range(9)]
    df = spark.createDataFrame(rows, "video long, frame long, phase long, value double").withColumn("emission", F.array(*[-F.abs(F.col("phase") - k) * 1.0 for k in range(hmm.N_PHASES)]))
    log_pi, log_a = hmm.log_table(hmm.initial_distribution(df)), hmm.log_table(hmm.transition_probabilities(df, trajectory.segments(df)))
    stream = None
    for k in range(3):
        df.filter(((F.col("frame") - 1) / 3).cast("int") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        query = streams.filtered_states(stream, log_pi, log_a).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()
    got = {(r.video, r.frame): r.state for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.video, r.frame): r.state for r in scan.decode(df, log_pi, log_a).collect()}
    assert got == want and np.exp(log_pi).sum() == pytest.approx(1)


def test_streamed_ingest_replaces_documents(spark, tmp_path):
    batches = [[("a", 1, "# H\none"), ("b", 1, "two"), ("b", 2, "newer"), ("b", 1, "older"), ("c", 1, "gone"), (None, 1, "x")], [("b", 3, "three"), ("c", 2, ""), ("a", 0, "stale")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "document_id string, version long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("document_id string, version long, text string").parquet(f"{tmp_path}/in/*")
        query = streams.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=2)
        query.processAllAvailable()
        query.stop()
        got = {(r.document_id, r.content) for r in streams.chunks_of(spark, f"{tmp_path}/out").collect()}
        assert got == ({("a", "one"), ("b", "newer"), ("c", "gone")} if k == 0 else {("a", "one"), ("b", "three")})


def test_models_are_read_as_they_were_saved(spark, tmp_path, small):
    series = trajectory.frames_from_events(spark.read.parquet(f"{small}/events.parquet"))
    tables = {"initial": hmm.initial_distribution(series), "prior": hmm.state_prior(series)}
    files.save_model(spark, f"{tmp_path}/m", "hmm", tables, {"alpha": 2.0})
    files.save_model(spark, f"{tmp_path}/m", "hmm", tables, {"alpha": 0.5})
    back, settings = files.load_model(spark, f"{tmp_path}/m", "hmm")
    assert settings == {"alpha": 0.5} and set(back) == {"initial", "prior"}
    for name, rows in tables.items():
        assert back[name].exceptAll(rows).count() == 0 == rows.exceptAll(back[name]).count()
    with pytest.raises(ValueError):
        files.load_model(spark, f"{tmp_path}/m", "semi_hmm")
