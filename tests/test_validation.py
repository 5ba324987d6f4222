"""Rules over claims: each fires on a made sentence and stays silent on its neighbour."""

import pytest
from pyspark.sql import functions as F

from phaseloom.operators import grounding, validation

# sentence, context (1: model t7, annotation t4 > t6; 2: the same with hours and a return; 3: nothing known), rules that fire
CASES = [
    ("La phase dominante juste avant etait t7.", 1, {"R2_prediction_is_not_observation"}),
    ("Le modele predit la phase t7.", 1, set()),
    ("Les phases sont t2, t3, t4, t5, t6, t7.", 1, set()),
    ("t7 -> t8 -> t7.", 1, set()),
    ("La phase actuelle est t4.", 1, set()),
    ("L'annotation montre la transition t7 -> t8.", 1, {"R2b_transition_provenance"}),
    ("Le modele predit la transition t4 -> t6.", 1, {"R2b_transition_provenance"}),
    ("Un saut de phase a ete annote ici.", 4, {"R3_annotated_skip_is_not_predicted_skip"}),
    ("Le modele predit un saut de phase.", 5, {"R3_annotated_skip_is_not_predicted_skip"}),
    ("Le decalage est de 2 fenetres pour la phase.", 1, {"R11_offset_is_not_a_lag"}),
    ("Le decalage est de 2 fenetres pour la phase.", 2, set()),
    ("Le decalage de la phase est non calculable, 2 fenetres.", 1, set()),
    ("Il s'agit d'un clivage direct.", 1, {"R8_definition_absent_from_corpus"}),
    ("Il n'y a pas eu de clivage.", 1, {"R4_absence_of_evidence_is_not_evidence_of_absence"}),
    ("Il n'y a pas de donnees sur le clivage.", 1, set()),
    ("La duree depuis l'ICSI compte.", 1, {"R10_no_insemination_assumption"}),
    ("La transition dure 43,1 heures.", 1, {"R9_timing_requires_unit_and_origin"}),
    ("La transition dure 43,1 heures.", 3, {"R9_timing_requires_unit_and_origin"}),
    ("La transition dure 43,1 heures.", 2, set()),
    ("Le timing est atypique.", 1, {"R9b_median_is_not_a_range"}),
    ("Le timing est dans la plage attendue.", 1, {"R9b_median_is_not_a_range"}),
    ("La phase est compatible avec les reperes morphocinetiques.", 1, {"R9c_morphokinetic_compatibility_requires_time_basis", "R7_consensus_silent"}),
    ("Il y a des retours vers la phase.", 1, {"R12_phase_return_claim_vs_stability"}),
    ("Il y a des retours vers la phase.", 2, set()),
    ("Aucun retour de phase.", 1, set()),
    ("Le diagnostic est bon.", 1, {"R13_clinical_claims_extra_caution"}),
    ("La phase provoque un saut.", 1, {"R6_association_is_not_causation"}),
    ("La phase est compatible, ce qui confirme tout.", 1, {"R5_compatible_is_not_proven", "R7_consensus_silent"}),
    ("Le modele predit une phase compatible.", 1, {"R14_consensus_never_validates_a_prediction", "R7_consensus_silent"}),
    ("La phase de l'embryon indique une bonne qualite.", 1, {"R1_observation_is_not_interpretation"}),
    ("Le referentiel place la phase ici.", 1, {"R7_consensus_silent"}),
]


@pytest.fixture(scope="module")
def context(spark):
    facts = spark.createDataFrame(
        [(1, "unknown/unverified", True, None, True, 0), (2, "hours", True, -1.0, True, 2), (3, None, None, None, None, None), (4, None, None, None, None, None), (5, None, None, None, None, None)],
        "ctx long, time_unit string, lag_printed boolean, lag double, returns_printed boolean, n_returns long",
    )
    phases = spark.createDataFrame([(c, p, k) for c in (1, 2) for p, k in (("t7", "MODEL_DERIVED"), ("T8", "MODEL_DERIVED"), ("t4", "OBSERVED"), ("t6", "OBSERVED"), (None, "OBSERVED"))], "ctx long, phase string, class string")
    moves = spark.createDataFrame([(1, "t7", "t8", "MODEL_DERIVED"), (1, "t4", "t6", "OBSERVED"), (4, "t7", "t9", "MODEL_DERIVED"), (5, "t4", "t6", "OBSERVED"), (5, None, "t6", "OBSERVED")], "ctx long, from string, to string, class string")
    return validation.contexts(facts, phases, moves, "ctx")


def test_rules_fire_where_they_should(spark, context):
    rows = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(CASES)], "id long, text string, ctx long")
    found = grounding.claims(rows, "text", "id").join(rows.select("id", "ctx"), "id")
    got = {r.sentence_no: set(r.fired) for r in validation.judged(found.withColumn("sentence_no", F.col("id")).drop("id"), context, "ctx").collect()}
    wrong = {CASES[i][0]: (got.get(i), want) for i, (_, _, want) in enumerate(CASES) if got.get(i, set()) != want}
    assert not wrong
    assert {r for _, _, fired in CASES for r in fired} == {r[0] for r in validation.rules()}


def test_verdicts_and_provenance(spark, context):
    text = "Le modele predit t7. La phase est t4 selon l'annotation, le modele predit t7. La phase est indisponible. La phase t7 = 0,25"
    found = grounding.claims(spark.createDataFrame([(1, text), (3, None), (3, "")], "ctx long, text string"), "text", "ctx")
    fields = spark.createDataFrame([(1, "phase_probabilities", "t7", 0.2513, "MODEL_DERIVED"), (1, "W1.model_phase", "t8", None, "MODEL_DERIVED")], "ctx long, field string, phase string, value double, class string")
    rows = validation.judged(validation.restated(found, fields, "ctx"), context, "ctx").orderBy("sentence_no").collect()
    assert [r.status for r in rows] == ["SUPPORTED", "SUPPORTED", "NOT_ASSESSABLE", "SUPPORTED"]
    assert [r.provenance for r in rows] == ["MODEL_DERIVED", "COMBINED", "SYSTEM", "MODEL_DERIVED"]
    assert rows[1].components == ["MODEL_DERIVED", "OBSERVED"] and rows[2].reason == "missing_data"
    bare = validation.judged(found, context, "ctx").orderBy("sentence_no").collect()
    assert bare[3].rule == "R2_prediction_is_not_observation"
    alone = validation.judged(found, context.limit(0), "ctx")
    assert alone.count() == 4 and validation.judged(found.limit(0), context, "ctx").count() == 0
    hit = validation.judged(grounding.claims(spark.createDataFrame([(1, "Le diagnostic de la phase.")], "ctx long, text string"), "text", "ctx"), context, "ctx")
    blocks = spark.createDataFrame([("IC2025-LIM-01", "a"), (None, "b")], "block_id string, body string")
    assert sorted((r.block_id, r.is_known) for r in validation.with_limitations(hit, blocks, "ctx").collect()) == [("IC2025-LIM-01", True), ("IC2025-LIM-16", False), ("IC2025-STATUS-01", False)]


def test_lines_of_lists_take_the_framing_above(spark):
    text = "Le modele predit la sequence suivante :\nW157 : phase t7\nt8: phase t8\n* phase t9\nElle dure. Une phase libre."
    rows = {r.sentence: r.framing for r in grounding.claims(spark.createDataFrame([(1, text)], "ctx long, text string"), "text", "ctx").collect()}
    assert rows["W157 : phase t7"] == rows["t8: phase t8"] == rows["* phase t9"] == ["MODEL_DERIVED"] and rows["Une phase libre."] == []


@pytest.mark.parametrize(
    "text,copied",
    [("phase t7 : -0,25", ["t7"]), ("phase t7 = 2.5e-1", []), ("phase t4 = 2.5e-1", ["t4"]), ("phase t7 = -0.3", ["t7"]), ("phase t7 = 0.25", []), ("phase t8 = 5", ["t8"]), ("phase t8 = 6", []),
     ("W1 : t6", ["t6"]), ("w1.model_phase = t5", ["t5"]), ("W1 . next_phase : t5", []), ("W2 : t6", [])],
)
def test_restated_fields(spark, text, copied):
    found = grounding.claims(spark.createDataFrame([(1, f"La phase : {text}")], "ctx long, text string"), "text", "ctx")
    fields = spark.createDataFrame([(1, "p", "t7", -0.2513, "MODEL_DERIVED"), (1, "p", "t4", 0.25, "MODEL_DERIVED"), (1, "p", "t8", 5.0, "MODEL_DERIVED"), (1, "W1", "t6", None, "OBSERVED"), (1, "W1.model_phase", "t5", None, "MODEL_DERIVED")], "ctx long, field string, phase string, value double, class string")
    assert validation.restated(found, fields, "ctx").first().copied == copied
