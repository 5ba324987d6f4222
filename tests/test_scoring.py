import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.functions import registered
from phaseloom.functions import vocabulary as V
from phaseloom.operators import grounding, hmm, metrics, scan, trajectory, vectors
from phaseloom.streaming import frames as streams


def brute_areas(prob, label):
    pos, neg = prob[label == 1], prob[label == 0]
    auroc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) if len(pos) and len(neg) else None
    steps = [(np.sum(pos >= t) / np.sum(prob >= t)) * np.sum(pos == t) for t in np.unique(prob)]
    return auroc, np.sum(steps) / len(pos) if len(pos) else None


def test_multiclass_scores_equal_numpy(spark):
    rng = np.random.default_rng(3)
    probs = rng.dirichlet([1, 1, 1, 1], 200).round(2)
    probs[:5, 3] = 0.0
    truth = rng.integers(0, 3, 200)  # the fourth class never occurs
    rows = spark.createDataFrame([(p.tolist(), int(t)) for p, t in zip(probs, truth)], "probs array<double>, truth long")
    per = {r["class"]: r for r in metrics.class_areas(rows, 4).collect()}
    assert per[3].auroc is None and per[3].average_precision is None and per[3].support == 0
    want = [brute_areas(probs[:, c], (truth == c).astype(int)) for c in range(3)]
    for c in range(3):
        assert (per[c].auroc, per[c].average_precision) == pytest.approx(want[c])
    got = metrics.multiclass_scores(rows, 4).first()
    support = np.bincount(truth, minlength=3)
    assert got.macro_ap == pytest.approx(np.mean([w[1] for w in want])) and got.weighted_ap == pytest.approx(np.average([w[1] for w in want], weights=support))
    assert got.brier == pytest.approx(np.mean(((np.eye(4)[truth] - probs) ** 2).sum(axis=1)))
    kept = np.clip(probs, 1e-12, 1)
    assert got.log_loss == pytest.approx(-np.mean(np.log(kept[np.arange(200), truth] / kept.sum(axis=1))))
    top, hit = probs.max(axis=1), (probs.argmax(axis=1) == truth).astype(float)
    place = np.searchsorted(np.array(metrics.EDGES)[1:-1], top, side="right")
    ece = sum(abs(top[place == b].mean() - hit[place == b].mean()) * (place == b).sum() for b in np.unique(place)) / 200
    assert got.ece == pytest.approx(ece) and got.accuracy == pytest.approx(hit.mean()) and got.n == 200


def test_filtered_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x, tags = rng.normal(size=(60, 4)), [None if i % 11 == 0 else "abc"[i % 3] if i else "rare" for i in range(60)]
    tags[7] = "rare"
    rows = spark.createDataFrame([(i, x[i].tolist(), tags[i]) for i in range(60)] + [(60, None, "a"), (61, [0.0] * 4, "a")], "vec_id long, embedding array<double>, tag string")
    wanted = {3: "a", 4: None, 5: "rare", 6: "nowhere"}
    asked = rows.filter(F.col("vec_id").isin(list(wanted))).withColumn("want", F.element_at(F.create_map(*[F.lit(v) for kv in wanted.items() for v in kv]), F.col("vec_id")))
    got = vectors.cosine_topk(asked, rows, 5, block=7, places=3, match={"tag": "want"}).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q, tag in wanted.items():
        near = sorted((-float(unit[q] @ unit[i]), i) for i in range(60) if i != q and (tag is None or tags[i] == tag))[:5]
        want |= {(q, n, i) for n, (_, i) in enumerate(near, 1)}
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == want and sum(r.query_id == 5 for r in got) == 1


def test_projection_equals_singular_values(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(80, None)], "i long, v array<double>").repartition(3)
    mean, axes = vectors.principal_axes(rows, "v", 5)
    _, size, found = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(np.sum(axes * found, axis=1)), 1)
    flat = vectors.projected(rows, "v", mean, axes[:2]).orderBy("i").collect()
    assert flat[80].projection is None and np.allclose([r.projection for r in flat[:80]], (x - mean) @ axes[:2].T)
    for k in (0, 2, 5):
        got = vectors.reconstruction(rows, "v", mean, axes[:k].reshape(k, 5)).first()
        assert got.n == 80 and got.mse == pytest.approx((size[k:] ** 2).sum() / 400, abs=1e-9) and got.explained == pytest.approx((size[:k] ** 2).sum() / (size**2).sum())
    with pytest.raises(ValueError):
        vectors.principal_axes(rows, "v", 6)
    with pytest.raises(ValueError):
        vectors.principal_axes(rows.filter("i = 80"), "v", 1)


def test_spans_cut_the_same_sentences(spark):
    texts = ["Un. Deux !  Trois;quatre\n\n cinq é😀. ", "", "  \n. a", None, "x" * 5000 + ". " + "y. " * 2000, ".. ?\n!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in grounding.sentence_spans(rows, "text", "id").orderBy("id", "sentence_no").collect():
        got.setdefault(r.id, []).append((r.sentence, r.start, r.end))
    for k, text in enumerate(texts):
        want, at = [], 0
        for piece in re.split(V.SENTENCE_END, text or ""):
            at = (text or "").find(piece, at) if piece else at
            if piece.strip(" "):
                want.append((piece.strip(" "), at, at + len(piece)))
            at += len(piece)
        assert got.get(k, []) == want
    same = grounding.sentences(rows, "text").select("id", "sentence_no", "sentence")
    assert grounding.sentence_spans(rows, "text", "id").select("id", "sentence_no", "sentence").exceptAll(same).count() == 0


def test_functions_in_sql(spark):
    registered.register(spark)
    registered.register(spark)
    rows = [("a", 1, 2), ("a", 2, 2), ("a", 3, None), ("a", 5, 3), ("b", 1, None), ("d", 1, None), ("d", 2, 6), ("c", 2, 1), ("c", 1, 4)]
    df = spark.createDataFrame(rows, "v string, at int, p int")
    got = spark.sql("SELECT * FROM segments(TABLE({t}), 'v', 'at', 'p')", t=df).collect()
    assert {tuple(r) for r in got} == {("a", 0, 2, 1, 3, 3), ("a", 1, 3, 5, 5, 1), ("b", 0, None, 1, 1, 1), ("d", 0, 6, 1, 2, 2), ("c", 0, 4, 1, 1, 1), ("c", 1, 1, 2, 2, 1)}
    assert spark.sql("SELECT * FROM segments(TABLE({t}), 'v', 'at', 'p')", t=df.limit(0)).count() == 0
    with pytest.raises(Exception, match="lacks q"):
        spark.sql("SELECT * FROM segments(TABLE({t}), 'v', 'at', 'q')", t=df).collect()
    scores = spark.createDataFrame([("a", 0.5, 1, 1), ("a", 0.9, 1, 0), ("a", 0.5, 0, 1), ("a", None, 4, 4), ("b", 0.2, 0, 3), ("c", 0.1, 2, 0)], "v string, prob double, pos long, neg long")
    areas = {r.v: tuple(r)[1:] for r in spark.sql("SELECT * FROM ranking_areas(TABLE({t}), 'v')", t=scores).collect()}
    assert areas["a"] == (2, 2, 0.75, pytest.approx((1 + 2 / 4) / 2)) and areas["b"] == (0, 3, None, None) and areas["c"] == (2, 0, None, 1.0)
    one = spark.sql("SELECT probability_bin(0.3D), probability_bin(1D), probability_bin(0D), probability_bin(NULL), clipped_log_loss(1D, 0)").first()
    assert tuple(one)[:4] == (2, 9, 0, None) and one[4] == pytest.approx(-np.log(1e-7))
    assert spark.sql("SELECT calibration_error(n, p, o) AS e FROM VALUES (3L, 0.5D, 1D), (1L, 0.25D, 0D), (0L, NULL, NULL) AS t(n, p, o)").first().e == pytest.approx(1.75 / 4)


def test_streamed_filter_waits_for_frames(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(v, i + 1, min(4, i // 3 + v), (i + 1) * 10) for v in range(2) for i in range(12)]
    emitted = F.array(*[-F.abs(F.col("phase") - k) * 1.0 for k in range(hmm.N_PHASES)])
    df = spark.createDataFrame(rows, "video long, frame long, phase long, at long").withColumn("emission", emitted).withColumn("ts", F.timestamp_seconds("at"))
    log_pi, log_a = hmm.log_table(hmm.initial_distribution(df)), hmm.log_table(hmm.transition_probabilities(df, trajectory.segments(df)))

    def play(name, batches, late, patience):
        got = []
        for k, keep in enumerate(batches):
            df.filter(keep).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}/in")
            query = streams.ordered_states(stream, log_pi, log_a, late, patience).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/cp").start()
            query.processAllAvailable()
            query.stop()
            got = [(r.video, r.frame, r.state) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect()]
        return got

    try:
        # the middle comes first, the beginning last, one frame twice; nothing is given up
        got = play("late", ["frame between 5 and 8", "frame > 8 or frame = 6", "frame < 5"], "1 hour", 3_600_000)
        want = {(r.video, r.frame, r.state) for r in scan.decode(df, log_pi, log_a).collect()}
        assert {r for r in got if r[2] is not None} == want and sorted(r for r in got if r[2] is None) == [(0, 6, None), (1, 6, None)] and len(got) == 26
        # frame 3 never comes: the watermark passes the frames that wait, and they go on without it
        got = play("gap", ["frame in (1, 2, 4)", "frame between 5 and 11", "frame = 12"], "0 seconds", 20_000)
        want = {(r.video, r.frame, r.state) for r in scan.decode(df.filter("frame <> 3"), log_pi, log_a).collect()}
        assert {r for r in got if r[1] < 12} == {r for r in want if r[1] < 12}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
