"""Lookups of windows, tools with typed errors, contexts and the scientific reference."""

import pytest
from pyspark.sql import functions as F

from phaseloom.functions import vocabulary as V
from phaseloom.operators import serving, tools, trajectory
from phaseloom.operators.grounding import any_of


@pytest.fixture(scope="module")
def world(spark):
    """Two videos: 12 frames of one phase and then the next, and 9 frames whose middle window spans three phases and is not kept."""
    rows = [(1, f, 2 if f <= 6 else 3) for f in range(1, 13)] + [(5, f, p) for f, p in enumerate([4, 4, 4, 4, 4, 4, 4, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 6], 1)]
    frames = spark.createDataFrame(rows, "video long, frame long, phase long")
    return frames, trajectory.with_window_start(trajectory.sliding_windows(frames))


def test_windows_map_to_their_frames(spark, world):
    frames, windows = world
    kept = {(r.video, r.window_start): r.first_frame for r in windows.collect()}
    last = max(kept)[1]
    asked = spark.createDataFrame([(1, 1, 0), (2, 1, 4), (3, 1, 5), (4, 5, 4), (5, 5, last), (6, 5, last + 1), (7, 9, 0), (8, 1, None), (9, None, 0), (10, 1, 0)], "id long, video long, window_start long")
    got = {r.id: r for r in serving.window_frames(asked, windows, frames).collect()}
    assert len(got) == 10 and got[1].frames == list(range(1, 9)) and got[2].frames == list(range(5, 13)) and got[10].frames == got[1].frames
    assert {i: got[i].error for i in got} == {1: None, 2: None, 3: "no such window", 4: "no such window", 5: None, 6: "no such window", 7: "unknown video", 8: "no such window", 9: "unknown video", 10: None}
    assert got[5].first_frame == kept[5, last] and got[5].last_frame == kept[5, last] + 7
    gone = serving.window_frames(asked.filter("id = 2"), windows, frames.filter("frame < 12")).first()
    assert gone.error == "frames missing" and gone.frames is None


def test_truth_and_times_have_default_records(spark, world):
    _, windows = world
    asked = spark.createDataFrame([(1, 1, 0), (2, 1, 99), (3, 1, 1), (4, 1, 2)], "id long, video long, window_start long")
    times = spark.createDataFrame([(1, 0, 1.0, 3.0, 2.0, 2.0, 1, True), (1, 1, 1.0, 3.0, 2.0, 2.0, 0, False)], "video long, window_start long, start_time double, end_time double, mid_time double, duration double, n_zero_steps long, is_complete boolean")
    got = {r.id: r for r in serving.with_times(serving.with_truth(asked, windows), times).collect()}
    assert (got[1].truth_phase, got[1].truth_flag, got[1].time_start, got[1].n_zero_steps, got[1].time_available) == (3, 1, 1.0, 1, True)
    assert (got[2].truth_phase, got[2].truth_flag, got[2].time_start, got[2].time_available, got[2].time_unit) == (None, None, None, False, "unknown/unverified")
    assert not got[3].time_available and got[3].time_mid is None and got[3].truth_phase == 3 and not got[4].time_available


def test_bands_are_clamped_and_stay_in_their_video(spark, world):
    _, windows = world
    asked = spark.createDataFrame([(1, 1, 1), (2, 5, 5), (3, 1, 77)], "id long, video long, window_start long")
    rows = serving.band(asked, windows, "id", 2, 9).orderBy("id", "offset").collect()
    assert [(r.window_start, r.offset, r.is_center) for r in rows if r.id == 1] == [(0, -1, False), (1, 0, True), (2, 1, False), (3, 2, False), (4, 3, False)]
    assert {r.video for r in rows if r.id == 2} == {5} and min(r.offset for r in rows if r.id == 2) == 0 and not [r for r in rows if r.id == 3]
    for bad in ((-1, 2), (0, 0)):
        with pytest.raises(ValueError):
            serving.band(asked, windows, "id", *bad)


def test_transition_context_needs_two_transitions(spark):
    schema = "video long, from_phase long, to_phase long, window_start long, window_end long, distance long, is_skip long"
    events = spark.createDataFrame([(1, 2, 3, 10, 11, 1, 0), (1, 3, 5, 20, 21, 2, 1), (1, 5, 6, 30, 31, 1, 0), (2, 2, 3, 5, 6, 1, 0)], schema)
    asked = spark.createDataFrame([(1, 1, 20), (2, 1, 9), (3, 1, 99), (4, 2, 5), (5, 1, None), (6, 3, 1)], "id long, video long, window_start long")
    got = {r.id: r for r in serving.transition_context(asked, events, "id").collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].n_before, got[1].n_after, got[1].last["no"], got[1].last["to_phase"], got[1].next["window_start"]) == (2, 1, 1, 5, 30)
    assert got[2].last is None and got[2].next["no"] == 0 and got[3].next is None and got[3].last["no"] == 2


QUESTIONS = [
    (1, "Quelle est la phase actuelle de cette video ?", 1, 1, "val"), (2, "Quelle est la phase actuelle de cette video ?", 1, 1, "test"), (3, "Quelle est la phase actuelle de cette video ?", 9, 1, "val"),
    (4, "Quelle est la phase actuelle de cette video ?", 1, 55, "val"), (5, "Quelle est la phase actuelle de cette video ?", 1, None, "val"), (6, "Quelle est la phase actuelle de cette video ?", None, None, "val"),
    (7, "Depuis combien de temps dure la phase actuelle ?", 1, 2, "TRAIN"), (8, "Quelle a été la dernière transition de cette video ?", 1, 0, "val"), (9, "Quelle transition est visible dans cette fenetre ?", 1, 0, "val"),
    (10, "Quelle version du modèle est chargée ?", None, None, "val"), (11, "Qu’est-ce que la phase tPNf ?", None, None, None), (12, "La phase est-elle stable après la transition de cette video ?", 5, 5, "val"),
    (13, "Bonjour", 1, 1, "val"), (14, None, 1, 1, "val"), (15, "L'ordre attendu du développement de cette video ?", 1, 1, "val"),
]


@pytest.fixture(scope="module")
def planned(spark):
    return tools.plan(spark.createDataFrame(QUESTIONS, "id long, question string, video long, window long, split string"))


def sources(spark, world, **without):
    _, windows = world
    p = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.when(i == F.col("last_frame_phase"), 0.9).otherwise(0.1 / 14))
    runs = trajectory.segments(windows, phase="last_frame_phase", order="window_start")
    own = {
        "windows": windows, "posteriors": windows.select("video", "window_start", p.alias("filtered"), p.alias("next_phase")), "segments": runs, "events": trajectory.transition_events(runs),
        "documents": spark.createDataFrame([(1, "phase tpnf definition"), (2, "rien"), (3, "developpement tpb2 teb")], "block_id long, text string"), "model": spark.createDataFrame([("m", "1")], "name string, version string"),
    }
    return tools.Sources(**(own | without))


def test_plans(planned):
    got = {r.id: r for r in planned.collect()}
    assert got[1].called == [tools.INFERENCE] and got[5].called == [tools.TRAJECTORY] and got[6].called == []
    assert got[7].called == [tools.INFERENCE, tools.TRAJECTORY] and got[10].called == [tools.METADATA] and got[11].called == [tools.DOCUMENTS, tools.PHASE] and got[11].phases == ["tpnf"]
    assert (got[8].scope, got[9].scope) == ("full_history", "current_window") and tools.EVENTS in got[8].called
    assert got[12].called == [tools.INFERENCE, tools.EVENTS, tools.HISTORY] and got[13].called == got[14].called == []
    for r in got.values():
        named = [x.tool for x in r.not_called]
        assert len(set(named) | set(r.called)) == (6 if r.id == 5 else 7) and not set(named) & set(r.called) and all(x.reason for x in r.not_called)


def test_results_are_values_or_typed_errors(spark, world, planned):
    rows = {(r.id, r.tool): r for r in tools.execute(planned, sources(spark, world)).collect()}
    assert set(rows) == {(r.id, t) for r in planned.collect() for t in r.called}
    assert rows[1, tools.INFERENCE].value == "t2=0.9000 next t2=0.9000"
    assert [(rows[i, tools.INFERENCE].ok, rows[i, tools.INFERENCE].error_type) for i in (1, 2, 3, 4)] == [(True, None), (False, tools.INPUT_ERROR), (False, tools.NOT_FOUND), (False, tools.NOT_FOUND)]
    assert rows[7, tools.TRAJECTORY].ok and rows[7, tools.TRAJECTORY].n_items == 1 and rows[10, tools.METADATA].value == "m 1"
    assert rows[8, tools.EVENTS].n_items == 0 and rows[8, tools.EVENTS].ok and rows[12, tools.HISTORY].n_items >= 1
    assert rows[11, tools.DOCUMENTS].value == "1" and rows[11, tools.PHASE].value == "1 3"
    assert set(rows[15, tools.DOCUMENTS].value.split()) == {"1", "3"}  # phases are asked for too, as its inference names them all


def test_missing_tables_are_unavailable_and_stop_nothing(spark, world, planned):
    rows = {(r.id, r.tool): r for r in tools.execute(planned, sources(spark, world, posteriors=None, documents=None, model=None)).collect()}
    assert {k[1] for k, r in rows.items() if r.error_type == tools.UNAVAILABLE} == {tools.INFERENCE, tools.HISTORY, tools.METADATA, tools.DOCUMENTS, tools.PHASE}
    assert rows[7, tools.TRAJECTORY].ok and len(rows) == sum(len(r.called) for r in planned.collect())


def test_contexts_keep_kinds_apart_and_failures_as_warnings(spark, world, planned):
    results = tools.execute(planned, sources(spark, world))
    got = {r.id: r for r in tools.contexts(planned, results).collect()}
    assert len(got) == len(QUESTIONS)
    assert got[1].dynamic.keys() == {tools.INFERENCE} and got[1].documents == [] and got[1].warnings == []
    assert [d.tool for d in got[11].documents] == [tools.DOCUMENTS, tools.PHASE] and got[11].dynamic == {} and got[11].warnings == ["get_phase_information is a text search, not a glossary of phases"]
    assert got[2].warnings == ["get_current_inference failed (ToolInputError): split not served: test"] and got[2].provenance[0].status == "error" and got[2].dynamic == {}
    assert got[13].provenance == [] and got[13].tools_called == [] and got[13].category == "UNKNOWN"


def test_reference_has_a_gate_and_its_limitations(spark):
    asked = spark.createDataFrame([(1, "Un clivage direct est-il possible ?"), (2, "Avec quel decalage ?"), (3, "Est-ce compatible ?"), (4, None)], "id long, question string")
    blocks = [("B1", "abnormal cleavage order"), ("B2", "direct cleavage abnormal"), ("B3", "nothing here"), *((b, "scope text") for names in V.LIMITATIONS.values() for b in names if b != "IC2025-ABSENT-01")]
    rows = tools.scientific_reference(asked, spark.createDataFrame(sorted(set(blocks)), "block_id string, text string")).collect()
    assert {r.id for r in rows} == {1, 3}
    assert [(r.block_id, r.rank) for r in sorted(rows, key=lambda r: r["rank"] or 99) if r.id == 1 and r.role == "evidence"] == [("B2", 1), ("B1", 2)]
    first = {r.block_id: r.score for r in rows if r.id == 1 and r.role == "evidence"}
    terms = {"clivage", "direct", "possible", "cleavage", "abnormal", "dc1", "dc2"}
    assert first["B2"] == pytest.approx(round(3 / (len(terms) ** 0.5 + 3**0.5) * 2, 4))
    assert {(r.block_id, r.role) for r in rows if r.id == 1 and r.role != "evidence"} == {("IC2025-ABSENT-01", "missing"), *((b, "limitation") for t in ("direct_cleavage", "biological") for b in V.LIMITATIONS[t] if b != "IC2025-ABSENT-01")}


def test_reference_reads_each_question_once(spark):
    read = spark.sparkContext.accumulator(0)

    def said(question):
        read.add(1)
        return question

    asked = spark.createDataFrame([(k, "Un clivage direct est-il possible ?") for k in range(40)], "id long, question string")
    asked = asked.withColumn("question", F.udf(said, "string").asNondeterministic()("question"))
    blocks = spark.createDataFrame([("B1", "direct cleavage abnormal"), ("B2", "cleavage order")], "block_id string, text string")
    rows = tools.scientific_reference(asked, blocks).collect()
    assert len({r.id for r in rows}) == 40 and read.value == 40


def test_phrases_are_found_as_they_stand(spark):
    rows = spark.createDataFrame([("50% (a.b)",), ("50 axb",), ("a\\Eb",), (None,)], "t string")
    found = rows.select(any_of(F.col("t"), ("(a.b)", "\\E", "zzz")).alias("x")).collect()
    assert [r.x for r in found] == [True, False, True, None]


def test_a_plan_folds_its_question_twice_at_most(spark):
    """Once for the category and once for the tools, however many lists of phrases are looked for."""
    asked = spark.createDataFrame([(1, "Bonjour.", 1, 1, "val")], "id long, question string, video long, window long, split string")
    assert tools.plan(asked)._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2


def test_a_plan_folds_its_question_once(spark):
    """The category and the tools look for their phrases in one folded text."""
    asked = spark.createDataFrame([(1, "Bonjour.", 1, 1, "val")], "id long, question string, video long, window long, split string")
    assert tools.plan(asked)._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_questions_of_one_phase_are_one_search(spark, monkeypatch):
    asked = spark.createDataFrame([(i, "Qu'est-ce que la phase tPNf ?" if i % 3 else "Qu'est-ce que la phase t4 ?", None, None, "val") for i in range(9)], "id long, question string, video long, window long, split string")
    blocks = spark.createDataFrame([(7, "definition of the phase tpnf"), (8, "phase t4")], "block_id long, text string")
    searches, search = [], tools.corpus.lexical_topk
    monkeypatch.setattr(tools.corpus, "lexical_topk", lambda queries, *more: searches.append(queries.count()) or search(queries, *more))
    found = tools.execute(tools.plan(asked), tools.Sources(documents=blocks))
    assert searches == [9, 2]
    values = {r["id"]: r["value"] for r in found.filter(found.tool == tools.PHASE).collect()}
    assert values == {i: "7 8" for i in range(9)}
