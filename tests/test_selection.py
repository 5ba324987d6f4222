import itertools
import math
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.operators import hmm, metrics, scan, selection, trajectory


def test_paired_tests_equal_enumeration(spark):
    rng = np.random.default_rng(11)
    rows = [(v, int(rng.integers(0, 2)), round(float(rng.random()), 3), round(float(rng.random()), 3)) for v in range(9) for _ in range(v + 3)] + [(9, 1, 0.25, 0.25), (10, None, 0.5, 0.1), (11, 1, None, 0.1)]
    df = spark.createDataFrame(rows, "video long, label long, a double, b double")
    per = {r.video: r for r in selection.video_deltas(df).collect()}
    assert set(per) == set(range(10))  # rows without label or probability make no video
    want = {v: np.mean([(b - y) ** 2 - (a - y) ** 2 for w, y, a, b in rows if w == v]) for v in range(10)}
    assert all(per[v].delta == pytest.approx(want[v]) for v in want)
    got = selection.paired_tests(selection.video_deltas(df)).first()
    d = np.array(list(want.values()))
    live = d[np.abs(d) > 1e-15]
    ranks = np.argsort(np.argsort(np.abs(live))) + 1
    plus = ranks[live > 0].sum()
    least = min(plus, ranks.sum() - plus)
    worse = sum(sum(r for r, up in zip(range(1, 10), signs) if up) <= least for signs in itertools.product((0, 1), repeat=9))
    assert (got.n, got.n_tied, got.w_plus) == (10, 1, plus) and got.wilcoxon_p == pytest.approx(min(1, 2 * worse / 2**9))
    assert got.t == pytest.approx(d.mean() / (d.std(ddof=1) / 10**0.5)) and got.ttest_p == pytest.approx(selection.t_test_p(got.t, 9)) and got.median == pytest.approx(np.median(d))


def test_tests_without_differences(spark):
    none = selection.paired_tests(spark.createDataFrame([], "delta double")).first()
    assert (none.n, none.t, none.ttest_p, none.wilcoxon_p, none.sign_p) == (0, None, None, 1.0, 1.0)
    same = selection.paired_tests(spark.createDataFrame([(0.0,), (0.0,), (None,)], "delta double")).first()
    assert (same.n, same.n_tied, same.t, same.ttest_p, same.wilcoxon_p) == (2, 2, None, None, 1.0)


@pytest.mark.parametrize("df, t", [(1, 12.706204736), (2, 4.302652730), (9, 2.262157163), (74, 1.992543495), (1000, 1.962339081)])
def test_two_sided_t(df, t):
    assert selection.t_test_p(t, df) == pytest.approx(0.05, abs=1e-8) and selection.t_test_p(-t, df) == selection.t_test_p(t, df)
    assert selection.t_test_p(0.0, df) == pytest.approx(1) and selection.t_test_p(None, df) is None


def test_sweep_equals_single_fits(spark):
    rows = [(v, i + 1, min(4, (i + v) // 4)) for v in range(4) for i in range(16) if (v, i) != (3, 9)]
    df = spark.createDataFrame(rows, "video long, frame long, phase long")
    train, odd = df.filter("video % 2 = 0"), df.filter("video % 2 = 1")
    asked = odd.withColumn("emission", F.array(*[-F.abs(F.col("phase") - F.col("frame") % 2 - k) * 0.7 for k in range(hmm.N_PHASES)])).drop("phase")
    got = {(r.alpha, r.rho): r for r in selection.hmm_sweep(train, asked, odd, [0.5, 2.0], [0.5], k=2).collect()}
    assert sorted(r.config_no for r in got.values()) == [0, 1]
    truth = {(v, i): p for v, i, p in rows if v % 2}
    flags = {(v, i): int(p != truth[v, i - 2]) for (v, i), p in truth.items() if (v, i - 1) in truth and (v, i - 2) in truth}
    for alpha in (0.5, 2.0):
        log_a = hmm.log_table(hmm.transition_probabilities(train, trajectory.segments(train), alpha, 0.5))
        one = {(r.video, r.frame): r for r in scan.decode(asked, hmm.log_table(hmm.initial_distribution(train)), log_a, 2, 0.2).collect()}
        row = got[alpha, 0.5]
        assert row.n == len(flags) and row.phase_accuracy == pytest.approx(np.mean([one[x].state == truth[x] for x in truth]))
        assert row.log_likelihood == pytest.approx(np.mean([r.log_norm for r in one.values()])) and row.brier == pytest.approx(np.mean([(one[x].change_k - flags[x]) ** 2 for x in flags]))
        p, y = np.array([one[x].change_k for x in flags]), np.array(list(flags.values()))
        assert row.auroc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]))
    chosen = metrics.select_config(selection.hmm_sweep(train, asked, odd, [2.0], [0.5], k=2), 0.0).first()
    assert chosen.reason == "chosen"


def test_sign_test_of_many_videos_is_exact_and_quick():
    def exact(wins, losses):
        n, term, total = wins + losses, 1, 0
        for i in range(min(wins, losses) + 1):
            total, term = total + term, term * (n - i) // (i + 1)
        return min(1.0, float(Fraction(2 * total, 2**n)))

    for wins, losses in ((0, 0), (0, 1200), (1, 1100), (500, 501), (700, 900), (900, 700), (2990, 3010), (3000, 3000), (5700, 6300)):
        assert metrics.sign_test_p(wins, losses) == pytest.approx(exact(wins, losses), rel=1e-11, abs=1e-300)
    begun = time.process_time()
    assert metrics.sign_test_p(13_493_000, 13_507_000) == pytest.approx(math.erfc((14_000 - 1) / math.sqrt(2 * 27_000_000)), rel=1e-4)
    assert time.process_time() - begun < 5


def test_steps_add_numbers_where_they_can_and_logs_elsewhere():
    rng = np.random.default_rng(5)
    log_a = np.where(np.triu(np.ones((5, 5))) > 0, np.log(rng.random((5, 5))), hmm.NEVER)
    x = np.log(rng.random((40, 3, 5))) * np.array([1.0, 300.0])[rng.integers(0, 2, (40, 1, 1))]
    x[::7, :, 2] = hmm.NEVER
    got, want = scan.step(x, log_a), hmm._logsumexp(x[..., :, None] + log_a, axis=-2)
    assert np.allclose(np.where(got > hmm.NEVER / 2, got, 0), np.where(want > hmm.NEVER / 2, want, 0), rtol=1e-12) and ((got > hmm.NEVER / 2) == (want > hmm.NEVER / 2)).all()


def test_changes_of_forward_models_hold_no_pairs_of_phases(monkeypatch):
    rng = np.random.default_rng(6)
    log_pi, b = np.log(np.full(6, 1 / 6)), np.log(rng.random((2, 30, 6)))
    a = np.triu(rng.random((6, 6))) + 0.01 * np.eye(6)
    log_a = np.where(a > 0, np.log(np.maximum(a / a.sum(axis=1, keepdims=True), 1e-300)), hmm.NEVER)
    before = np.concatenate([np.zeros((2, 1)), np.full((2, 6), hmm.NEVER)], axis=1)
    want = [hmm.change_within(log_pi, log_a, one, 4, 0.2) for one in b]
    monkeypatch.setattr(np, "trace", None)  # what the old way summed: an array of rows by phases by phases
    got = scan.replayed(log_pi, log_a, b, np.array([30, 30]), before, np.zeros((2, 6)), 4, False)["change_k"]
    assert np.allclose(got[:, 4:], np.array(want)[:, 4:], atol=1e-12)


def test_emissions_are_plain_columns(spark):
    model = hmm.Emissions(np.array([[0.5, -1.0], [2.0, 0.25], [0.0, 0.0]]), np.array([0.1, -0.2, 0.0]), np.log([0.5, 0.3, 0.2]), np.array([True, True, False]))
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [None, 1.0]), (3, None), (4, [1.0]), (5, [1.0, 2.0, 3.0])], "id long, x array<double>")
    found = hmm.with_emissions(rows, model, "x")
    assert found.columns == ["id", "x", "emission"] and "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    by = {r.id: r.emission for r in found.collect()}
    logits = np.array([0.1 + 0.5 - 2.0, -0.2 + 2.0 + 0.5])
    assert by[1] == pytest.approx([*(logits - np.log(np.exp(logits).sum()) - np.log([0.5, 0.3])), hmm.NEVER])
    assert all(by[i] == [0.0, 0.0, hmm.NEVER] for i in (2, 3, 4, 5))
