"""Block scans against the row-by-row recursions; the explicit-duration model, as it is fitted, against enumeration of all segmentations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.operators import hmm, scan, semimarkov, trajectory

SERIES = "video long, frame long, emission array<double>"


def made(spark, rng, n, lengths, gaps=0.0):
    rows = {}
    for v, length in enumerate(lengths):
        frames = [f for f in range(1, length + 1) if rng.random() >= gaps] or [1]
        rows[v] = (np.array(frames), np.log(rng.random((len(frames), n)) + 1e-3))
    flat = [(v, int(f), [float(x) for x in e]) for v, (frames, b) in rows.items() for f, e in zip(frames, b, strict=True)]
    rng.shuffle(flat)
    return rows, spark.createDataFrame([(int(v), int(f), list(e)) for v, f, e in flat], SERIES)


def forward_model(rng, n):
    a = np.triu(rng.random((n, n)) + 0.05)
    return np.log(np.full(n, 1 / n)), np.where(a > 0, np.log(np.maximum(a / a.sum(1, keepdims=True), 1e-300)), hmm.NEVER)


@pytest.mark.parametrize("size,gaps,k", [(5, 0.0, 3), (7, 0.3, 2), (16, 0.6, 7), (1000, 0.2, 3)])
def test_blocks_equal_rows(spark, size, gaps, k):
    rng = np.random.default_rng(size)
    log_pi, log_a = forward_model(rng, 4)
    rows, df = made(spark, rng, 4, [1, 2, 4, 5, 6, 23, 60, 61], gaps)
    if size > k:
        found = {}
        for r in scan.decode(df, log_pi, log_a, k, 0.2, size).collect():
            found.setdefault(r.video, {})[r.frame] = r
        paths = {(r.video, r.frame): r.viterbi_state for r in scan.best_paths(df, log_pi, log_a, size).collect()}
        for v, (frames, b) in rows.items():
            own, total = hmm.forward(log_pi, log_a, b)
            got = [found[v][int(f)] for f in frames]
            assert len(found[v]) == len(frames)
            assert np.array([r.filtered for r in got]) == pytest.approx(np.exp(own), abs=1e-9)
            assert sum(r.log_norm for r in got) == pytest.approx(total, abs=1e-9)
            assert [r.smoothed_state for r in got] == hmm.smoothed(log_pi, log_a, b).argmax(axis=1).tolist()
            for name, lag in (("change_prob", 1), ("change_k", k)):
                assert [r[name] for r in got] == pytest.approx(hmm.change_within(log_pi, log_a, b, lag, 0.2, frames).tolist(), abs=1e-9)
            assert [paths[v, int(f)] for f in frames] == hmm.viterbi(log_pi, log_a, b)[0].tolist()
    likelihood = {r.video: r.log_likelihood for r in scan.log_likelihoods(scan.decode(df, log_pi, log_a, 1, 0.2, max(size, 2), smooth=False)).collect()}
    assert likelihood == pytest.approx({v: hmm.forward(log_pi, log_a, b)[1] for v, (_, b) in rows.items()}, abs=1e-9)


def test_one_long_video_is_many_groups(spark):
    rng = np.random.default_rng(1)
    log_pi, log_a = forward_model(rng, 5)
    b = np.log(rng.random((20_000, 5)) + 1e-3)
    df = spark.range(20_000).join(spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(b)], "id long, emission array<double>"), "id").select(F.lit(7).cast("long").alias("video"), (F.col("id") + 1).alias("frame"), "emission")
    found = scan.decode(df, log_pi, log_a, 3, 0.2, 512)
    got = {r.frame: r for r in found.select("frame", "filtered", "log_norm").collect()}
    own, total = hmm.forward(log_pi, log_a, b)
    assert max(abs(np.array(got[t + 1].filtered) - np.exp(own[t])).max() for t in range(len(b))) < 1e-9
    assert math.fsum(r.log_norm for r in got.values()) == pytest.approx(total, rel=1e-12)
    groups = scan.blocks(df, 512, 3).filter("own").groupBy("block").count().collect()
    assert len(groups) == 40 and max(r["count"] for r in groups) == 512
    paths = {r.frame: r.viterbi_state for r in scan.best_paths(df, log_pi, log_a, 512).collect()}
    assert [paths[t + 1] for t in range(len(b))] == hmm.viterbi(log_pi, log_a, b)[0].tolist()


def test_empty_series_and_short_blocks(spark):
    none = spark.createDataFrame([], SERIES)
    log_pi, log_a = forward_model(np.random.default_rng(0), 3)
    assert scan.decode(none, log_pi, log_a).count() == 0 and scan.best_paths(none, log_pi, log_a).count() == 0
    with pytest.raises(ValueError):
        scan.decode(none, log_pi, log_a, k=5, size=5)


def enumerated(model, b, upto):
    """Of all ways to cut rows 0 .. upto into segments: weights by phase and age at the last row."""
    n, most = model.pmf.shape
    beyond = np.cumsum(model.pmf[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros((n, most))

    def walk(t, phase, w):
        for length in range(1, most + 1):
            if t + length > upto + 1:
                return
            here = w * np.exp(b[t : t + length, phase].sum())
            if t + length == upto + 1:
                out[phase, length - 1] += here * beyond[phase, length - 1]
                return
            for nxt in range(n):
                if model.lead[phase, nxt]:
                    walk(t + length, nxt, here * model.pmf[phase, length - 1] * model.lead[phase, nxt])

    for phase in range(n):
        walk(0, phase, model.pi[phase])
    return out / out.sum() if out.sum() > 0 else model.rest


@pytest.fixture
def trained(spark):
    rng = np.random.default_rng(4)
    rows = []
    for v in range(12):
        frame, phase = 1, int(rng.integers(0, 2))
        while phase < 4:
            for _ in range(int(rng.integers(1, 5))):
                rows.append((v, frame, phase, 1.0))
                frame += 1
            phase += int(rng.integers(1, 3))
    return spark.createDataFrame(rows, "video long, frame long, phase long, value double")


@pytest.mark.parametrize("family", semimarkov.FAMILIES)
def test_fitted_durations_match_enumeration(spark, trained, family):
    model = semimarkov.fit(trained, family, n=4)
    assert model.pmf.shape == (4, 4) and model.pmf.sum(axis=1) == pytest.approx(np.ones(4)) and not np.tril(model.lead).any() and not model.lead[3].any()
    rng = np.random.default_rng(5)
    rows, df = made(spark, rng, 4, [1, 4, 6, 8])
    found = {}
    for r in semimarkov.decode(df, model, 2, 0.2).collect():
        found.setdefault(r.video, {})[r.frame] = r
    for v, (frames, b) in rows.items():
        for t in range(len(b)):
            at, got = enumerated(model, b, t), found[v][int(frames[t])]
            assert got.filtered == pytest.approx(at.sum(axis=1).tolist(), abs=1e-12)
            assert got.age == pytest.approx((at * np.arange(1, 5)).sum())
            assert got.change_prob == pytest.approx(at[:, :1].sum() if t >= 1 else 0.2) and got.change_k == pytest.approx(at[:, :2].sum() if t >= 2 else 0.2)
            more = enumerated(model, np.concatenate([b[: t + 1], np.zeros((1, 4))]), t + 1).sum(axis=1)
            assert got.next_phase == pytest.approx(more.tolist(), abs=1e-9)


def test_long_videos_go_on_from_their_state(spark, trained, monkeypatch):
    model, rng = semimarkov.fit(trained, n=4), np.random.default_rng(6)
    _, df = made(spark, rng, 4, [50, 3, 120, 1, 77], 0.1)
    whole = sorted(map(tuple, semimarkov.decode(df, model, 3, 0.2).collect()))
    run = semimarkov._decoded(model, 3, 0.2)
    import pyarrow as pa

    rows = df.orderBy("video", "frame").collect()
    table = pa.table({"video": [r.video for r in rows], "frame": [r.frame for r in rows], "emission": pa.array([r.emission for r in rows], pa.list_(pa.float64()))})
    monkeypatch.setattr(semimarkov, "ROWS", 16)
    cut = sorted(tuple(r.values()) for batch in run(iter(table.to_batches(max_chunksize=7))) for r in batch.to_pylist())
    assert len(cut) == len(whole)
    for a, b in zip(whole, cut, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=1e-12)


def test_a_matrix_that_stays_is_refused(spark, trained):
    with pytest.raises(ValueError):
        semimarkov.Model(np.full(3, 1 / 3), np.eye(3), np.full((3, 2), 0.5))
    with pytest.raises(ValueError):
        semimarkov.fit(trained, "gamma", n=4)
    with pytest.raises(ValueError):
        semimarkov.fit(trained, strategy="none", n=4)
    assert semimarkov.fit(trained, strategy="explicit", n=4).pmf.shape == (4, 268)
    none = semimarkov.fit(trained.limit(0), n=4)
    assert none.pmf.shape == (4, 1) and none.pi.tolist() == [0.25] * 4
    last = semimarkov.decode(spark.createDataFrame([(0, f, [0.0, 0.0, 0.0, float(-f)]) for f in range(1, 9)], SERIES), none, 2)
    assert all(sum(r.filtered) == pytest.approx(1) for r in last.collect())


def test_explicit_durations_name_more_phases_than_the_classifier(spark):
    from phaseloom.plans import states

    rows = states.phase_decoding_accuracy(spark, "/root/testdata/sf0.01").agg(F.avg("hmm"), F.avg("semi_hmm"), F.avg("emission")).first()
    assert rows[1] >= 0.86 and rows[1] > rows[2] and rows[0] > rows[2]


def test_chain_of_segments(spark, trained):
    runs = trajectory.segments(trained)
    durations, lead = hmm.empirical_durations(runs, 3, n=4), hmm.segment_probabilities(runs, n=4)
    rows = semimarkov.chain(runs, durations, lead).collect()
    p = {(r.phase, r.d): r.p for r in durations.collect()}
    assert len(rows) == runs.count()
    for r in rows:
        assert r.duration_p == p[r.phase, min(r.duration, 3)] and (sum(r.next_phases.values()) == pytest.approx(1) if r.phase < 3 else r.next_phases == {})


def test_frames_of_the_state_models_are_numbered_once(spark, small):
    from phaseloom.plans import catalog

    for rows in catalog.observed(spark, small):
        assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
