"""Claims of answers judged by rules against what their context says: classes of provenance, lags, returns, units of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.functions import vocabulary as V
from phaseloom.operators.grounding import any_of, folded, transition_claims

MODEL = ("MODEL_DERIVED", "DERIVED_FROM_MODEL")
SEEN = ("OBSERVED", "DERIVED_FROM_OBSERVED")
#: Statuses by severity, the worst last.
SEVERITY = ("SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_ASSESSABLE", "NOT_SUPPORTED", "CONTRADICTED")
_CLASSES = "array<string>"


def _list(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast(_CLASSES)


def _any(found: Column, *names: str) -> Column:
    return F.arrays_overlap(found, _list(names))


def contexts(facts: DataFrame, phases: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """One row for each context of `facts`, which may say time_unit, lag_printed, lag, returns_printed and n_returns: with `at`, the classes that
    name a phase, and `moved`, the classes that hold a transition (`t4>t6`).

    phases: key, phase, class. moves: key, from, to, class. Phases are compared in lower case, nulls left out. Both maps are
    bounded by the number of phases and classes, however large the answers are.
    """

    def gathered(rows: DataFrame, name: Column, out: str) -> DataFrame:
        rows = rows.select(key, name.alias("n"), "class").filter("n is not null and class is not null")
        each = rows.groupBy(key, "n").agg(F.array_sort(F.collect_set("class")).alias("classes"))
        return each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("n", "classes"))).alias(out))

    known = [c for c in ("time_unit", "lag_printed", "lag", "returns_printed", "n_returns") if c in facts.columns]
    rest = {"time_unit": F.lit(None).cast("string"), "lag_printed": F.lit(False), "lag": F.lit(None).cast("double"), "returns_printed": F.lit(False), "n_returns": F.lit(None).cast("long")}
    rows = facts.select(key, *known).withColumns({c: v for c, v in rest.items() if c not in known})
    rows = rows.join(gathered(phases, F.lower("phase"), "at"), key, "left")
    return rows.join(gathered(moves, F.concat(F.lower("from"), F.lit(">"), F.lower("to")), "moved"), key, "left")


def restated(found: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """Adds copied (phases) and copied_classes: phases that a sentence copies from a printed field (key, field, phase, value, class).

    `t7 = 0,25` or `t7 : 0.25` is a copy if a field gives t7 a value that begins with these digits or lies within half a unit of
    their last decimal, or is the very number if there are none or an exponent; `W157=t8`, `W157 : t8` or `W157.model_phase=t8` is one if a field of that name holds t8.
    """
    said = F.regexp_replace("sentence", "[*`_]{2,}", "")

    def groups(pattern: str, *names: str) -> Column:
        parts = [F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(k + 1)), F.lower) for k in range(len(names))]
        return F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names, strict=True)])

    number, window = groups(V.PHASE_VALUE, "phase", "value"), groups(V.WINDOW_PHASE, "window", "part", "phase")
    each = found.select(key, "sentence_no", F.explode(F.concat(
        F.transform(number, lambda x: F.struct(F.lit("number").alias("form"), F.lit(None).cast("string").alias("field"), x["phase"].alias("phase"), F.translate(x["value"], ",", ".").alias("said"))),
        F.transform(window, lambda x: F.struct(F.lit("window").alias("form"), F.concat(x["window"], F.when(x["part"] != "", F.concat(F.lit("."), x["part"])).otherwise("")).alias("field"), x["phase"].alias("phase"), F.lit(None).cast("string").alias("said"))),
    )).alias("x")).select(key, "sentence_no", "x.*")
    have = fields.select(key, F.lower("field").alias("own_field"), F.lower("phase").alias("phase"), F.col("value").cast("double").alias("value"), "class")
    both = each.join(have, [key, "phase"])
    places = F.length(F.regexp_extract("said", r"^[^e]*\.(\d+)$", 1))
    near = F.when(places > 0, F.abs(F.col("value") - F.col("said").cast("double")) <= F.pow(F.lit(10.0), -places) / 2).otherwise(F.col("value") == F.col("said").cast("double"))
    close = F.startswith(F.col("value").cast("string"), F.col("said")) | near
    fits = F.when(F.col("form") == "number", close).otherwise(F.col("own_field") == F.col("field"))
    per = both.filter(fits).groupBy(key, "sentence_no").agg(F.array_sort(F.collect_set("phase")).alias("copied"), F.array_sort(F.collect_set("class")).alias("copied_classes"))
    none = F.array().cast(_CLASSES)
    return found.join(per, [key, "sentence_no"], "left").withColumns({c: F.coalesce(c, none) for c in ("copied", "copied_classes")})


def described(found: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Claims with their context and what the rules ask of both: low, phases, pairs, model_only, observed_only, by_model, by_seen.

    Claims without a context are judged against an empty one. `retrieved` (bool) and `copied` are taken as they are, false and
    empty if the claims do not have them.
    """
    none = F.array().cast(_CLASSES)
    rows = found.join(context, key, "left")
    defaults = {"retrieved": F.lit(False), "copied": none, "copied_classes": none}
    rows = rows.withColumns({c: v for c, v in defaults.items() if c not in found.columns})
    tokens = F.regexp_extract_all("sentence", F.lit(V.PHASE_IN_ANSWER), F.lit(0))
    rows = rows.withColumns({"low": folded(F.col("sentence")), "phases": F.array_distinct(F.transform(tokens, F.lower)), "pairs": transition_claims(F.col("sentence"))})

    def classes(phase: Column) -> Column:
        return F.coalesce(F.element_at("at", phase), none)

    def only(one: tuple[str, ...], other: tuple[str, ...]) -> Column:
        return F.filter("phases", lambda p: _any(classes(p), *one) & ~_any(classes(p), *other))

    return rows.withColumns({
        "model_only": F.array_except(only(MODEL, SEEN), F.col("copied")), "observed_only": only(SEEN, MODEL),
        "by_model": _any(F.col("framing"), *MODEL), "by_seen": _any(F.col("framing"), *SEEN),
    })


def rules() -> list[tuple[str, Column, str, str | None, tuple[str, ...]]]:
    """(rule, condition, status, reason, limitations) over described claims; of rules that are equally severe the first counts."""
    low, found, framing, kind = F.col("low"), F.col("topics"), F.col("framing"), F.col("kind")
    bold, none = F.col("is_hedged") == 0, F.array().cast(_CLASSES)
    model, seen = F.col("by_model"), F.col("by_seen")
    scientific, cleavage = F.array_contains(framing, "SCIENTIFIC"), ("direct_cleavage", "reverse_cleavage", "chaotic_division")

    def says(words: tuple[str, ...]) -> Column:
        return any_of(low, words)

    def moved(pair: Column) -> Column:
        return F.coalesce(F.element_at("moved", F.concat(pair["from"], F.lit(">"), pair["to"])), none)

    def holds(side: str) -> Column:
        return F.coalesce(F.exists(F.map_values("moved"), lambda c: F.array_contains(c, side)), F.lit(False))

    seen_moves, model_moves = holds("OBSERVED"), holds("MODEL_DERIVED")
    out_of_order = F.filter("model_only", lambda p: ~(F.array_contains(F.coalesce(F.element_at("at", p), none), "SCIENTIFIC") & says(V.ORDER_WORDS)))
    chain = (F.regexp_count("sentence", F.lit(V.PHASE_IN_ANSWER)) >= 3) & (F.regexp_replace(F.regexp_replace(low, V.PHASE_IN_ANSWER, ""), V.CHAIN_FILLER, "") == "")
    unsure = F.lower("time_unit").isin("unknown/unverified", "unknown", "unverified")
    value = F.rlike(low, F.lit(r"[-+−]?\d+\s*fenetre")) | says(V.WINDOW_COUNTS)
    other_side = F.exists("pairs", lambda p: moved(p) == F.when(seen, _list(("MODEL_DERIVED",))).otherwise(_list(("OBSERVED",))))
    return [
        ("R2_prediction_is_not_observation", ~model & ~seen & ~scientific & bold & (F.size("phases") < 5) & ~chain & (F.size(out_of_order) > 0), "NOT_SUPPORTED", None, ()),
        ("R2b_transition_provenance", (model != seen) & other_side, "NOT_SUPPORTED", None, ()),
        ("R3_annotated_skip_is_not_predicted_skip", _any(found, "skip") & (model != seen) & ((F.array_contains(framing, "MODEL_DERIVED") & seen_moves & ~model_moves) | (F.array_contains(framing, "OBSERVED") & model_moves & ~seen_moves)), "NOT_SUPPORTED", None, ()),
        ("R11_offset_is_not_a_lag", says(V.LAG_WORDS) & bold & F.coalesce("lag_printed", F.lit(False)) & F.col("lag").isNull() & (value | says(V.LAG_DIRECTIONS)), "NOT_SUPPORTED", None, ()),
        ("R8_definition_absent_from_corpus", _any(found, *cleavage), "NOT_ASSESSABLE", "external_definition", ("IC2025-AC-B01", "IC2025-TERM-08", "IC2025-ABSENT-01")),
        ("R4_absence_of_evidence_is_not_evidence_of_absence", says(V.DENIALS) & ~says(V.DATA_ABSENT) & _any(found, *cleavage, "biological"), "NOT_ASSESSABLE", "missing_data", ("IC2025-ABSENT-06", "IC2025-ABSENT-07")),
        ("R10_no_insemination_assumption", says(V.INSEMINATION), "NOT_ASSESSABLE", "unknown_insemination_method", ("IC2025-T1", "IC2025-TIME-01")),
        ("R9_timing_requires_unit_and_origin", F.rlike(low, F.lit(V.TIMED)) & (F.coalesce("time_unit", F.lit("")).isin("") | unsure), "NOT_ASSESSABLE", "unverified_time_basis", ("IC2025-CP1-01", "IC2025-LIM-09")),
        ("R9b_median_is_not_a_range", _any(found, "timing") & bold & (says(V.TYPICAL) | says(V.DISPERSION)), "NOT_ASSESSABLE", "unverified_time_basis", ("IC2025-T1", "IC2025-LIM-09", "IC2025-KG-04")),
        ("R9c_morphokinetic_compatibility_requires_time_basis", _any(found, "compatibility") & bold & says(V.MORPHOKINETIC) & unsure, "NOT_ASSESSABLE", "unverified_time_basis", ("IC2025-CP1-01", "IC2025-LIM-09")),
        ("R12_phase_return_claim_vs_stability", _any(found, "stability", "regression") & bold & ~_any(found, *cleavage) & ~says(V.RETURN_DENIALS) & says(V.RETURN_ASSERTIONS) & F.col("returns_printed") & (F.col("n_returns") == 0), "NOT_SUPPORTED", None, ()),
        ("R13_clinical_claims_extra_caution", (kind == "CLINICAL_IMPLICATION") | _any(found, "clinical"), "NOT_ASSESSABLE", "out_of_scope", ("IC2025-STATUS-01", "IC2025-LIM-01", "IC2025-LIM-16")),
        ("R6_association_is_not_causation", (kind == "CAUSAL_CLAIM") | _any(found, "causal"), "NOT_SUPPORTED", None, ("IC2025-LIM-06", "IC2025-TIME-03")),
        ("R5_compatible_is_not_proven", _any(found, "compatibility") & says(V.PROVEN), "NOT_SUPPORTED", None, ("IC2025-LIM-01",)),
        ("R14_consensus_never_validates_a_prediction", (model | ((F.size("model_only") > 0) & ~scientific)) & (_any(found, "compatibility", "expected_development") | scientific), "PARTIALLY_SUPPORTED", None, ("IC2025-LIM-01", "IC2025-STATUS-01")),
        ("R1_observation_is_not_interpretation", _any(found, "biological") & bold & _any(found, "phase", "transition", "probability", "stability") & ~scientific & says(V.INTERPRETATIONS), "PARTIALLY_SUPPORTED", None, ("IC2025-LIM-01", "IC2025-STATUS-01")),
        ("R7_consensus_silent", (scientific | _any(found, "expected_development", "compatibility")) & ~F.col("retrieved"), "NOT_ASSESSABLE", "out_of_scope", ()),
    ]


def judged(found: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """key, sentence_no, sentence, status, rule, reason, fired, limitations, provenance and components of every claim.

    The worst status of all rules that hold counts, the first rule on ties. Where none holds, a sentence that names a phase or a
    transition and does not hedge is SUPPORTED, a hedged one NOT_ASSESSABLE for missing data, any other NOT_ASSESSABLE as out of
    scope. A rule whose facts are null does not hold. provenance: the class the sentence attributes itself to, with those that its
    phases come from; COMBINED, with its components, if there are several.
    """
    rows = described(found, context, key)
    none = F.array().cast(_CLASSES)
    hits = [
        F.when(cond, F.struct(F.lit(SEVERITY.index(status)).alias("severity"), F.lit(-k).alias("place"), F.lit(name).alias("rule"), F.lit(reason).cast("string").alias("reason"), _list(limits).alias("limits")))
        for k, (name, cond, status, reason, limits) in enumerate(rules())
    ]
    rows = rows.withColumn("hits", F.array_compact(F.array(*hits))).withColumn("worst", F.array_max(F.col("hits")))
    hedged, checkable = F.col("is_hedged") == 1, (F.size("phases") > 0) | (F.size("pairs") > 0)
    status = F.when(F.col("worst").isNotNull(), F.get(_list(SEVERITY), F.col("worst.severity"))).when(checkable & ~hedged, "SUPPORTED").otherwise("NOT_ASSESSABLE")
    reason = F.when(F.col("worst").isNotNull(), F.col("worst.reason")).when(hedged, "missing_data").when(~checkable, "out_of_scope")
    own = F.array_remove("framing", "SYSTEM")
    own = F.when(F.size(own) == 0, F.col("copied_classes")).otherwise(own)
    more = [F.when(cond, _list((name,))).otherwise(none) for cond, name in ((F.size("model_only") > 0, "MODEL_DERIVED"), (F.size("observed_only") > 0, "OBSERVED"), (F.col("retrieved"), "SCIENTIFIC"))]
    rows = rows.withColumn("classes", F.array_sort(F.array_distinct(F.concat(own, *more))))
    provenance = F.when(F.size("classes") > 1, "COMBINED").when(F.size("classes") == 1, F.get("classes", F.lit(0))).when(F.array_contains("framing", "SYSTEM"), "SYSTEM").otherwise("UNKNOWN")
    return rows.select(
        key, "sentence_no", "sentence", status.alias("status"), F.col("worst.rule").alias("rule"), reason.alias("reason"), F.transform("hits", lambda h: h["rule"]).alias("fired"),
        F.array_distinct(F.flatten(F.transform("hits", lambda h: h["limits"]))).alias("limitations"), provenance.alias("provenance"), F.when(F.size("classes") > 1, F.col("classes")).otherwise(none).alias("components"),
    )


def with_limitations(verdicts: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, sentence_no, block_id, body of the limitations that verdicts keep; `is_known` is false where the corpus (block_id, body) has no such block."""
    each = verdicts.select(key, "sentence_no", F.explode("limitations").alias("block_id"))
    have = blocks.select("block_id", "body").filter("block_id is not null").dropDuplicates(["block_id"])
    return each.join(have.withColumn("is_known", F.lit(True)), "block_id", "left").select(key, "sentence_no", "block_id", "body", F.coalesce("is_known", F.lit(False)).alias("is_known"))
