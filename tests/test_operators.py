"""The library's own operators: small inputs with known answers, brute force for recursions, and every query against its SQL."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.functions import distributions as D
from phaseloom.functions import vocabulary as V
from phaseloom.operators import audit, corpus, grounding, hmm, metrics, models, registry, sampling, scan, trajectory, vectors
from phaseloom.plans import catalog
from phaseloom.session import served_split

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    rows, columns = df.collect(), df.columns
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows is not None
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(columns)
    order = sorted(columns)
    left = sorted([tuple(plain(r[c]) for c in order) for r in rows], key=str)
    right = sorted([tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()], key=str)
    assert left == right


def series(spark, *videos):
    rows = [(v, i + 1, p, 1.0) for v, phases in enumerate(videos) for i, p in enumerate(phases)]
    return spark.createDataFrame(rows, "video long, frame long, phase long, value double")


def test_windows_keep_neighbouring_phases(spark):
    df = series(spark, [3] * 8, [3] * 4 + [4] * 4, [3] * 4 + [6] * 4, [3, 4, 5] * 3, [3] * 16, [1] * 7)
    got = trajectory.with_window_start(trajectory.sliding_windows(df)).orderBy("window_start").collect()
    assert [(r.video, r.window_start, r.consistency_flag) for r in got] == [(0, 0, 0), (1, 1, 1), *[(4, k, 0) for k in range(2, 11)]]
    assert trajectory.sliding_windows(df, any_phases=True).count() == 1 + 1 + 1 + 2 + 9
    assert trajectory.sliding_windows(df.limit(0)).count() == 0


def test_segments_events_and_censoring(spark):
    runs = trajectory.segments(series(spark, [3, 3, 3, 4, 4, 7, 7], [2, 2]))
    assert [(r.video, r.phase, r.start, r.end, r.duration, r.censoring) for r in runs.orderBy("video", "seg_no").collect()] == [(0, 3, 1, 3, 3, "LEFT"), (0, 4, 4, 5, 2, "OBSERVED"), (0, 7, 6, 7, 2, "RIGHT"), (1, 2, 1, 2, 2, "BOTH")]
    events = trajectory.transition_events(runs).orderBy("seg_no").collect()
    assert [(r.from_phase, r.to_phase, r.window_start, r.window_end, r.distance, r.is_skip) for r in events] == [(3, 4, 3, 4, 1, 0), (4, 7, 5, 6, 3, 1)]


def test_annotation_ranges(spark):
    frames = series(spark, [0] * 6)
    ranges = spark.createDataFrame([(0, 5, 1, 3, 0), (0, 6, 3, 4, 1)], "video long, phase long, frame_start long, frame_end long, range_no long")
    assert trajectory.explode_annotations(ranges, frames).count() == 5
    assert sorted((r.frame, r.range_phase) for r in trajectory.explode_annotations(ranges, frames, last_wins=True).collect()) == [(1, 5), (2, 5), (3, 6), (4, 6)]


def test_band_is_clamped(spark):
    df = series(spark, range(10))
    centre = spark.createDataFrame([(0, 2)], "video long, centre long")
    band = trajectory.history_band(df, centre, 3, 2).orderBy("frame").collect()
    assert [(r.frame, r.offset_from_center, r.truncated) for r in band] == [(1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 2, 1)]


def chain(n=3, t=5, seed=0):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) + 0.1)
    return np.log(np.full(n, 1 / n)), np.where(a > 0, np.log(np.maximum(a / a.sum(1, keepdims=True), 1e-300)), hmm.NEVER), np.log(rng.random((t, n)))


def paths(log_pi, log_a, b):
    for p in itertools.product(range(b.shape[1]), repeat=len(b)):
        yield p, log_pi[p[0]] + b[0][p[0]] + sum(log_a[x, y] + b[k + 1][y] for k, (x, y) in enumerate(itertools.pairwise(p)))


def test_recursions_match_path_enumeration():
    log_pi, log_a, b = chain()
    every = list(paths(log_pi, log_a, b))
    weight = np.exp([w for _, w in every])
    own, total = hmm.forward(log_pi, log_a, b)
    assert total == pytest.approx(math.log(weight.sum()))
    last = [sum(w for (p, _), w in zip(every, weight, strict=True) if p[-1] == s) / weight.sum() for s in range(3)]
    assert np.exp(own[-1]) == pytest.approx(last)
    middle = [sum(w for (p, _), w in zip(every, weight, strict=True) if p[2] == s) / weight.sum() for s in range(3)]
    assert np.exp(hmm.smoothed(log_pi, log_a, b)[2]) == pytest.approx(middle)
    path, score = hmm.viterbi(log_pi, log_a, b)
    assert tuple(path) == max(every, key=lambda x: x[1])[0] and score == pytest.approx(max(w for _, w in every))
    change = hmm.change_within(log_pi, log_a, b, 3, 0.25)
    assert list(change[:3]) == [0.25] * 3
    assert change[4] == pytest.approx(1 - sum(w for (p, _), w in zip(every, weight, strict=True) if p[1] == p[4]) / weight.sum())


def test_emissions_are_posterior_over_prior(spark):
    rng = np.random.default_rng(3)
    phases = rng.integers(0, 4, 400)
    rows = [(0, i + 1, int(p) if p < 3 else 5, [float(x) for x in np.array([10 * p, 0]) + rng.normal(0, 0.5, 2)]) for i, p in enumerate(phases)]
    df = spark.createDataFrame([*rows, (0, 900, 2, None), (0, 901, 2, [None, 1.0])], "video long, frame long, phase long, x array<double>")
    model = hmm.fit_emissions(df, "x", n=7)
    prior = {r.phase: r.p for r in hmm.state_prior(df.filter("frame < 900"), 1.0, 7).collect()}
    hits = 0
    for r in hmm.with_emissions(df, model, "x").collect():
        assert r.emission[4] == r.emission[6] == hmm.NEVER
        if r.frame < 900:
            hits += int(np.argmax(r.emission)) == r.phase
            logits = model.weights @ np.array(r.x) + model.bias
            seen = [0, 1, 2, 5]
            want = logits[seen] - np.log(np.exp(logits[seen] - logits[seen].max()).sum()) - logits[seen].max() - np.log([prior[k] for k in seen])
            assert [r.emission[k] for k in seen] == pytest.approx(want.tolist(), abs=1e-9)
        else:
            assert [r.emission[k] for k in (0, 1, 2, 5)] == [0.0] * 4
    assert hits == 400
    one = hmm.fit_emissions(df.filter("phase = 1"), "x", n=7)
    assert {tuple(round(v, 9) for v in r.emission) for r in hmm.with_emissions(df, one, "x").collect()} == {(0.0,) * 7}


def test_change_needs_the_row_exactly_k_before(spark):
    rng = np.random.default_rng(8)
    log_pi, log_a, b = np.log(np.full(3, 1 / 3)), np.log(np.array([[0.6, 0.3, 0.1], [1e-300, 0.7, 0.3], [1e-300, 1e-300, 1.0]])), np.log(rng.random((6, 3)))
    plain = hmm.change_within(log_pi, log_a, b, 2, 0.25)
    gapped = hmm.change_within(log_pi, log_a, b, 2, 0.25, np.array([1, 2, 3, 5, 6, 7]))
    assert gapped[:2].tolist() == [0.25] * 2 and gapped[3] == gapped[4] == 0.25
    assert gapped[2] == plain[2] and gapped[5] == plain[5] and (plain[2:] != 0.25).all()


def test_filtering_is_causal_and_equal_in_sql(spark):
    df = series(spark, [0, 0, 1, 1, 2, 4, 4], [2, 2, 3])
    log_pi, log_a = hmm.parameters(df)
    df = hmm.with_emissions(df.withColumn("x", F.array(F.col("value"), F.col("frame").cast("double"))), hmm.fit_emissions(df.withColumn("x", F.array("value", F.col("frame").cast("double"))), "x"), "x")
    whole = scan.decode(df, log_pi, log_a).orderBy("video", "frame").collect()
    part = scan.decode(df.filter("frame <= 3"), log_pi, log_a).orderBy("video", "frame").collect()
    assert [r.state for r in whole if r.frame <= 3] == [r.state for r in part]
    assert all(sum(r.filtered) == pytest.approx(1) for r in whole)
    sql = hmm.forward_in_sql(df, hmm.initial_distribution(df), hmm.transition_probabilities(df, trajectory.segments(df))).orderBy("video", "frame").collect()
    assert [r.state for r in sql] == [r.state for r in whole]
    assert [r.p for r in sql] == pytest.approx([max(r.filtered) for r in whole], abs=1e-9)


def test_durations_follow_their_data():
    pmf = hmm.negative_binomial(6.0, 2.5, 60)
    rng = np.random.default_rng(0)
    draws = rng.choice(np.arange(1, 61), 4000, p=pmf)
    mean, size = hmm.fit_negative_binomial(draws, np.ones(len(draws)), np.zeros(len(draws), bool))
    assert mean == pytest.approx(6, rel=0.1) and size == pytest.approx(2.5, rel=0.3) and pmf.sum() == pytest.approx(1)


def test_scores_of_known_predictions(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.3 + 1e-17, 1)], "prob double, label long")
    assert metrics.auroc(df.limit(4)).first()[0] == pytest.approx(0.75)
    assert metrics.auroc(df.filter("label = 1")).first()[0] is None
    assert metrics.average_precision(df.filter("prob <> 0.3")).first()[0] == pytest.approx(0.8333333)
    bins = {r.bin: r.n for r in metrics.calibration_bins(df).collect()}
    assert bins[2] == 1 and bins[3] == 1 and sum(bins.values()) == 5 and len(bins) == 10
    none = metrics.binary_metrics(df.filter("prob < 0.3")).first()
    assert none.f1 == 0 and none.precision == 0


def test_paired_tests(spark):
    same = spark.createDataFrame([(0.5, 0.5)] * 5, "a double, b double")
    r = metrics.paired_difference(same).first()
    assert r.cohen_d is None and metrics.wilcoxon_p(r.w_plus, r.w_minus, r.n_nonzero) == 1.0
    more = metrics.paired_difference(spark.createDataFrame([(0.0, float(i)) for i in range(1, 21)], "a double, b double")).first()
    assert (more.w_plus, more.w_minus) == (210, 0) and metrics.wilcoxon_p(more.w_plus, more.w_minus, 20) < 0.001
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "test string, p_value double")
    assert [r.rejected for r in metrics.holm(tests).orderBy("p_value").collect()] == [1, 1, 0, 0]
    assert metrics.t_quantile(0.975, 4) == pytest.approx(2.7764, abs=1e-3) and metrics.sign_test_p(5, 0) == pytest.approx(0.0625)


def test_signed_rank_test_is_exact_for_few_differences():
    assert metrics.wilcoxon_p(15, 0, 5) == 0.0625 and metrics.wilcoxon_p(10, 5, 5) == pytest.approx(0.625)
    assert metrics.wilcoxon_p(7.5, 7.5, 5, tie_term=6.0) == 1.0


def test_running_totals_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(None if x < 3 else float(x % 40), int(i)) for i, x in enumerate(rng.integers(0, 400, 500))]
    got = sampling.running_total(spark.createDataFrame(rows, "x double, n long"), F.col("x"), F.col("n"), "t", "n").collect()
    total, want = 0, {}
    for x, n in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        want[n], total = total, total + n
    assert {r.n: r.t for r in got} == want
    assert sampling.running_total(spark.createDataFrame([], "x double, n long"), F.col("x"), F.col("n"), "t").count() == 0


def test_cosine_search_meets_all_places(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.standard_normal(4)]) for i in range(90)]
    df = spark.createDataFrame(rows + [(500, None), (501, [0.0] * 4), (None, [1.0] * 4)], "vec_id long, embedding array<double>")
    got = vectors.cosine_topk(df.filter("vec_id % 20 = 0 or vec_id is null"), df, 7, block=8, places=5).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 90, 20):
        want = [i for i in np.lexsort((np.arange(90), -(x @ x[q]))) if i != q][:7]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    assert vectors.cosine_topk(df.limit(0), df, 7).count() == 0


def test_selection_and_splits(spark):
    grid = spark.createDataFrame([(0, 0.7, 0.20001, 0.8), (1, 0.72, 0.20004, 0.7), (2, 0.5, 0.1, 0.9)], "config_no long, auroc double, brier double, accuracy double")
    assert {r.config_no: r.reason for r in metrics.select_config(grid, 0.6).collect()} == {0: "eligible", 1: "chosen", 2: "below the auroc floor"}
    rows = spark.range(100).select(F.col("id").alias("video"))
    counts = {r.split: r["count"] for r in sampling.group_split(rows, "video").groupBy("split").count().collect()}
    assert counts == {"train": 70, "val": 15, "test": 15}
    with pytest.raises(PermissionError):
        served_split("Test")
    with pytest.raises(ValueError):
        served_split("other")


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    near = vectors.cosine_topk(rows.filter("vec_id = 0"), rows, 2).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [4, 1]
    checks = {r.check: r.n_bad for r in vectors.quality_checks(rows, "vec_id", "embedding", 2).collect()}
    assert checks["zero"] == 1 and checks["duplicate_vectors"] == 0
    perfect = vectors.cluster_agreement(spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "label long, cluster long")).first()
    assert perfect.ari == pytest.approx(1) and perfect.nmi == pytest.approx(1)


def test_linear_dynamics_are_found(spark):
    a, x, rows = np.array([[0.9, 0.1], [-0.2, 0.8]]), np.array([1.0, -1.0]), []
    for t in range(200):
        rows.append((0, t, x.tolist()))
        x = a @ x + np.array([0.1, 0.2]) + np.random.default_rng(t).normal(0, 0.3, 2)
    df = spark.createDataFrame(rows, "g long, t long, v array<double>")
    found, _ = vectors.linear_dynamics(df, "g", "t", "v", 1e-6)
    assert found == pytest.approx(a, abs=0.15)
    errors = vectors.forecast_errors(df, "g", "t", "v", found, np.array([0.1, 0.2]), [1]).first()
    assert errors.n == 199 and errors.mse < errors.naive_mse


def test_chunks_of_markdown(spark):
    text = "Intro line\n\n# One\nfirst\n\nsecond\n\n## Empty\n\n# Two\n```\n# not lost\ncode\n```\n| a |\n| b |\n\n" + "x" * 2700
    got = corpus.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text").orderBy("chunk_no").collect()
    assert [r.heading for r in got][:2] == ["(intro)", "One"] and got[1].content == "first\n\nsecond"
    assert all(r.id == 1 for r in got) and [r.chunk_id for r in got][:2] == ["1::0000", "1::0001"]
    assert any(r.n_chars > 2600 for r in got) and not any("Empty" == r.heading for r in got)


def plain_chunks(blocks, target, most):
    out = []
    for b in blocks:
        if out and len(out[-1]) < target and len(out[-1]) + 2 + len(b) <= most:
            out[-1] += "\n\n" + b
        else:
            out.append(b)
    return out


def test_packing_of_prose_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    blocks = ["w" * int(rng.integers(1, 120)) for _ in range(60)]
    got = corpus.chunks(spark.createDataFrame([(1, "\n\n".join(blocks))], "id long, text string"), "id", "text", 180, 260, 20).orderBy("chunk_no").collect()
    want = plain_chunks(blocks, 180, 260)
    assert [r.content.split("\n[...]\n")[-1] for r in got] == want
    assert all(g.content == w[-20:] + "\n[...]\n" + c for g, w, c in zip(got[1:], want, want[1:], strict=False))


def test_ingest_and_retrieval(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "document_id string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "document_id string, hash string")
    assert {r.document_id: r.action for r in corpus.ingest_plan(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "new"}
    assert {r.document_id: r.action for r in corpus.ingest_plan(old, new, True).collect()}["a"] == "version_bumped"
    ranked = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, 8), (2, 1, 9)], "query_id long, rank long, document_id long")
    relevant = spark.createDataFrame([(1, 7), (1, 5)], "query_id long, document_id long")
    got = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in corpus.retrieval_metrics(ranked, relevant).collect()}
    assert got[1] == pytest.approx((2 / 3, 0.5, 1.0)) and got[2] == (0.0, None, 0.0)
    assert corpus.digest(F.lit("x")) is not None


def test_compaction_keeps_what_is_measured(spark):
    text = "# Notes\nplain\nroadmap of work\nroadmap: score = 0.7\nfree offer\n\n"
    rules = ((("S1", ("publication",)),), (("L5", ("roadmap",)), ("L6", ("offer",))), (("K1", ("score",)),))
    got = corpus.compacted(spark.createDataFrame([(1, text), (2, "# Publication plan\nplain")], "id long, text string"), "id", "text", *rules).orderBy("id").collect()
    assert got[0].text == "# Notes\nplain\nroadmap: score = 0.7\n" or got[0].text == "# Notes\nplain\nroadmap: score = 0.7"
    assert got[0].rules == ["L5", "L6"] and got[0].n_dropped == 2 and got[1].text == "" and got[1].rules == ["S1"]


QUESTIONS = [("Quelle est la phase actuelle ?", "DYNAMIC_DATA"), ("Qu’est-ce que le Semi-HMM ?", "DOCUMENTARY"), ("Pourquoi le modèle prédit-il cette phase ?", "HYBRID"), ("Bonjour", "UNKNOWN"), ("La durée", "DOCUMENTARY"), (None, "UNKNOWN")]


def test_routing(spark):
    df = spark.createDataFrame([(q,) for q, _ in QUESTIONS], "text string")
    got = {r.text: r for r in grounding.route(df, "text").collect()}
    assert {q: got[q].category for q, _ in QUESTIONS} == dict(QUESTIONS)


def test_tokens_numbers_and_transitions(spark):
    text = "De T4 vers t6 puis t9+ -> tEB, entre t7 et t8; t2 et t3. Valeur 0,72 et −3 % ou 12"
    r = spark.createDataFrame([(text, "il y a 0.72 ; 12")], "a string, c string").select(grounding.phase_tokens(F.col("a")).alias("p"), grounding.transition_claims(F.col("a")).alias("t")).first()
    assert r.p == ["t4", "t6", "t9+", "teb", "t7", "t8", "t2", "t3"]
    assert sorted((x["from"], x["to"]) for x in r.t) == [("t4", "t6"), ("t7", "t8"), ("t9+", "teb")]
    g = grounding.grounding(spark.createDataFrame([(text, "il y a 0.72 ; 12")], "a string, c string"), "a", "c").first()
    assert g.checked == ["0,72", "−3", "12"] and g.ungrounded == ["−3"] and g.is_grounded == 0
    answers = spark.createDataFrame([(1, text)], "id long, a string")
    events = spark.createDataFrame([(1, "t4", "t6"), (1, "t9+", "tEB")], "id long, from string, to string")
    assert [(x["from"], x["to"]) for x in grounding.unsupported_transitions(answers, "a", events, "id").collect()] == [("t7", "t8")]


def test_claims_and_verdicts(spark):
    text = "Le modele predit la phase t7.\n- t8 avec une probabilite de 0.2\nLa phase est-elle t7 ?\nIl faut le transfert de l'embryon. La phase observee est t6, c'est une cause probable."
    found = grounding.claims(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "text", "id")
    rows = found.orderBy("sentence_no").collect()
    assert [r.kind for r in rows] == ["PREDICTION_STATEMENT", "DATA_STATEMENT", "CLINICAL_IMPLICATION", "CAUSAL_CLAIM"]
    assert rows[1].framing == ["MODEL_DERIVED"]
    judged = grounding.verdicts(found.withColumn("has_observed", F.lit(False)).withColumn("has_model", F.lit(True)))
    assert {r.status for r in judged.collect()} == {"SUPPORTED", "OUT_OF_SCOPE", "NOT_SUPPORTED"}
    assert grounding.report(judged, "id").first().worst == "NOT_SUPPORTED"
    sources = spark.createDataFrame([(1, "MODEL_DERIVED", "t7"), (1, "OBSERVED", "t5"), (1, "MODEL_DERIVED", "t6")], "id long, class string, token string")
    bad = {(r.token, r.reason) for r in grounding.provenance_mismatch(found, sources, "id").collect()}
    assert ("t8", "phase in no source") in bad and ("t6", "phase of another source") in bad
    assert len(V.HYBRID_PATTERNS) == 20


def test_registry(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "bob10"), (3, "bob9")], "user_id long, name string")
    roles = spark.createDataFrame([(1, "Doctor", "x"), (2, "Doctor", "y"), (3, "Admin", "z")], "user_id long, role string, password string")
    got = registry.listing(users, roles, "user_id", "Doctor")
    assert got.columns == ["user_id", "name", "role"] and got.count() == 2
    assert [r.name for r in users.orderBy(registry.natural_key(F.col("name"))).collect()] == ["Ann", "bob9", "bob10"]
    assert registry.search(users, "BOB").count() == 2
    changes = spark.createDataFrame([(1, "delete", None), (2, "update", "new"), (3, "update", None), (9, "insert", "x")], "user_id long, op string, name string")
    assert {(r.user_id, r.name) for r in registry.apply_changes(users, changes, "user_id").collect()} == {(2, "new"), (3, "bob9"), (9, "x")}


def test_json_trees(spark):
    a = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, 2]}, "x": null}'), (2, "no json")], "id long, j string")
    b = spark.createDataFrame([(1, '{"x": null, "a": {"c": [1, 3], "b": 1}, "d": true}')], "id long, j string")
    got = {(r.id, r.path): (r.left, r.right) for r in audit.json_diff(a, b, "id", "j").collect()}
    assert got == {(1, "a.c[1]"): ("2", "3"), (1, "d"): ("<absent>", "true"), (2, ""): ("no json", "<absent>")}
    same = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, '{"b":2,"a":1}')], "id long, j string")
    assert audit.canonical_hash(same, "id", "j").select("hash").distinct().count() == 1
    assert [r.path for r in audit.forbidden(a, "id", "j", ["b"]).collect()] == ["a.b"]
    lists = spark.createDataFrame([([3, 4, 5],), ([1, 3],), ([],)], "n array<long>").select(audit.summarised(F.col("n")).alias("s"))
    assert [r.s for r in lists.collect()] == ["3..5", "1,3", ""]


def test_distributions(spark):
    df = spark.createDataFrame([({"b": 0.4, "a": 0.4, "c": 0.2}, [0.1, 0.5, 0.5], [0.25, 0.25, 0.5])], "m map<string,double>, v array<double>, p array<double>")
    m = F.col("m")
    r = df.select(D.leader(m).alias("l"), D.runner_up(m).alias("r"), D.gap(m).alias("g"), D.omitted(m, 1).alias("o"), D.first_argmax(F.col("v")).alias("i"), D.quantile(F.col("p"), 0.5).alias("q"), D.logsumexp(F.col("v")).alias("s"), D.top_k(m, 2).alias("t")).first()
    assert (r.l, r.r, r.g, r.i, r.q, r.o["count"]) == ("a", "b", 0.0, 1, 2, 2) and list(r.t) == ["a", "b"]
    assert r.s == pytest.approx(math.log(sum(math.exp(x) for x in (0.1, 0.5, 0.5))))


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(v, t, (rng.normal(0, 0.1, 2) + ([3.0, 0.0] if t % 5 == 4 else [0.0, 0.0])).tolist(), int(t % 5 == 4)) for v in range(6) for t in range(40)]
    df = spark.createDataFrame(rows, "video long, window_start long, embedding array<double>, consistency_flag int")
    got = {r.model: r.auroc for r in models.ladder(df.filter("video < 4"), df.filter("video >= 4")).collect()}
    assert got["identity"] > 0.99 and got["base_rate"] == 0.5 and set(got) == set(models.MODELS)
    with pytest.raises(ValueError):
        models.model("identity")(None)
    a = np.array([[0.0, -1.0], [1.0, 0.0]])
    turn = spark.createDataFrame([(0, t, [math.cos(t * math.pi / 2), math.sin(t * math.pi / 2)]) for t in range(6)], "video long, window_start long, embedding array<double>")
    assert all(r.guess == pytest.approx(r.embedding, abs=1e-9) for r in models.imputed(turn, a, np.zeros(2)).collect())
    assert models.seed_interval([1.0, float("nan")]) == (1.0, None, None, None)
    assert models.seed_interval([1.0, 2.0, 3.0])[2] == pytest.approx(2 - 4.3027 / math.sqrt(3), abs=1e-3)


def test_multiclass_scores(spark):
    rng = np.random.default_rng(4)
    probs, truth = rng.dirichlet(np.ones(3), 60), rng.integers(0, 3, 60)
    df = spark.createDataFrame([([float(x) for x in p], int(t)) for p, t in zip(probs, truth)], "probs array<double>, truth long")
    areas = {}
    for r in metrics.one_against_rest(df, 3).collect():
        pos, neg = probs[truth == r["class"], r["class"]], probs[truth != r["class"], r["class"]]
        areas[r["class"]] = (np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]), len(pos))
        assert r.auroc == pytest.approx(areas[r["class"]][0]) and r.support == len(pos)
    got = metrics.ranking_summary(df, 3).first()
    assert got.macro_auroc == pytest.approx(np.mean([a for a, _ in areas.values()])) and got.weighted_auroc == pytest.approx(sum(a * n for a, n in areas.values()) / 60)
    assert got.log_loss == pytest.approx(-np.log(probs[np.arange(60), truth]).mean(), abs=1e-5) and got.accuracy == pytest.approx((probs.argmax(1) == truth).mean())
    assert metrics.ranking_summary(df.limit(0), 3).first().n == 0


def test_window_times_and_alignment(spark):
    rows = [(1, k, float(t) if t is not None else None) for k, t in enumerate([0, 10, 10, 30, None], 1)]
    df = spark.createDataFrame(rows, "video long, frame long, time double")
    got = [tuple(r) for r in trajectory.window_times(df, 3).orderBy("first_frame").collect()]
    assert got == [(1, 1, 0.0, 10.0, 5.0, 10.0, 1, 1), (1, 2, 10.0, 30.0, 20.0, 20.0, 1, 1), (1, 3, None, None, None, None, 0, 0)]
    a, b = df.select("video", "frame"), df.select("video", "frame", "time")
    assert trajectory.aligned(a, b, ["video", "frame"]).count() == 5
    for wrong in (b.filter("frame > 1"), b.union(b.limit(1))):
        with pytest.raises(ValueError, match="1 keys"):
            trajectory.aligned(a, wrong, ["video", "frame"])
