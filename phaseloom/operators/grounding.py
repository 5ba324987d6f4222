"""Questions and answers: routing, claims, framing, numbers and transitions, checked against what data says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import vocabulary as V


def folded(text: Column) -> Column:
    """Lower case without the accents of ACCENTS; null counts as empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *V.ACCENTS)


def words_of(phrases: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(p) for p in phrases])


def matched(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that a folded text contains, in their own order."""
    return F.filter(words_of(phrases), lambda p: F.contains(text, p))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text contains one of the phrases; one expression for all of them, as a condition for each would be planned and compiled each time. A pattern of alternatives would be tried at each character."""
    return F.exists(words_of(phrases), lambda p: F.contains(text, p))


def once(x: Column, f) -> Column:
    """f of a value that is computed once, however often f names it; filters and branches would compute it each time."""
    return F.get(F.transform(F.array(x), f), 0)


def route(questions: DataFrame, text: str, folded_text: str | None = None) -> DataFrame:
    """Adds category: HYBRID for an explicit pattern or both kinds of signal, else DYNAMIC_DATA, DOCUMENTARY (also for any known term), else UNKNOWN; and n_dynamic, n_documentary, n_domain.

    folded_text: a column that has the folded text already, and stays.
    """
    questions = questions if folded_text else questions.withColumn("_low", folded(F.col(text)))
    low = F.col(folded_text or "_low")
    hybrid, dynamic, documentary = (any_of(low, p) for p in (V.HYBRID_PATTERNS, V.DYNAMIC_KEYWORDS, V.DOCUMENTARY_KEYWORDS))
    category = F.when(hybrid | (dynamic & documentary), "HYBRID").when(dynamic, "DYNAMIC_DATA").when(documentary | any_of(low, V.DOMAIN_TERMS), "DOCUMENTARY").otherwise("UNKNOWN")
    counts = {"n_dynamic": V.DYNAMIC_KEYWORDS, "n_documentary": V.DOCUMENTARY_KEYWORDS, "n_domain": V.DOMAIN_TERMS}
    routed = questions.withColumn("category", category).withColumns({k: F.size(matched(low, p)).cast("long") for k, p in counts.items()})
    return routed if folded_text else routed.drop("_low")


def phase_tokens(text: Column) -> Column:
    """Phases named in a question, lower case, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.PHASE_IN_QUESTION), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def sentences(texts: DataFrame, text: str) -> DataFrame:
    """One row for each sentence that is not blank: the row's columns, sentence_no (from 0), sentence (trimmed)."""
    each = texts.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), V.SENTENCE_END)).alias("sentence_no", "sentence"))
    return each.withColumn("sentence", F.trim("sentence")).filter("sentence <> ''").withColumn("sentence_no", F.col("sentence_no").cast("long"))


def sentence_spans(texts: DataFrame, text: str, key: str) -> DataFrame:
    """key, sentence_no, sentence, start, end: `substring(text, start + 1, end - start)`, trimmed, is the sentence.

    Pieces and the gaps between them come from one pattern, so a piece begins where the lengths before it end. A key names one row;
    null and blank texts give none. A sentence's number counts blank pieces too, as in `sentences`.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    gaps = F.regexp_extract_all(source, F.lit(V.SENTENCE_END), F.lit(0))
    pieces = F.zip_with(F.split(source, V.SENTENCE_END), gaps, lambda p, g: F.struct(p.alias("piece"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))
    rows = texts.select(F.col(key), F.posexplode(pieces).alias("sentence_no", "x")).select(key, F.col("sentence_no").cast("long").alias("sentence_no"), "x.*")
    before = W.partitionBy(key).orderBy("sentence_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece") + F.col("gap")).over(before), F.lit(0)).cast("long")
    out = rows.withColumn("start", start).select(key, "sentence_no", F.trim("piece").alias("sentence"), "start", (F.col("start") + F.length("piece")).alias("end"))
    return out.filter("sentence <> ''")


def topics(sentence: Column) -> Column:
    """Topics that a sentence is about, sorted; identifiers of samples are no clinical words, a named phase is about phases."""
    low = F.regexp_replace(folded(sentence), r"(?:patient\s+)?patient_\d+\S*", " ")
    named = F.coalesce(F.rlike(sentence, F.lit(V.PHASE_IN_ANSWER)), F.lit(False))
    found = once(low, lambda x: F.array(*[F.when(any_of(x, words) | (named if topic == "phase" else F.lit(False)), topic) for topic, words in V.TOPICS.items()]))
    return F.array_sort(F.array_compact(found))


def claim_kind(found: Column, low: Column) -> Column:
    """What a sentence claims, by the first rule that holds."""

    def has(*names: str) -> Column:
        return F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(has("causal"), "CAUSAL_CLAIM").when(has("clinical"), "CLINICAL_IMPLICATION").when(has("compatibility", "expected_development"), "COMPATIBILITY_VERDICT")
        .when(has("direct_cleavage", "reverse_cleavage", "chaotic_division"), "DEFINITION").when(has("timing") & has("phase", "transition"), "TIMING_REFERENCE")
        .when(any_of(low, V.PREDICTION_WORDS), "PREDICTION_STATEMENT").when(has("probability", "uncertainty"), "DATA_STATEMENT")
        .when(has("biological") & ~has("phase"), "ASSOCIATION").otherwise("DATA_STATEMENT")
    )


def framing(text: Column) -> Column:
    """The classes of provenance that a sentence attributes itself to, sorted."""
    low = folded(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(low, words), name) for name, words in V.FRAMINGS.items()])))


def claims(texts: DataFrame, text: str, key: str) -> DataFrame:
    """Sentences with a topic that are no questions: key, sentence_no, sentence, topics, kind, framing, is_hedged.

    A sentence that continues a list or begins with a pronoun takes the framing of the last sentence before it that had one.
    """
    rows = sentences(texts, text)
    low = folded(F.col("sentence"))
    rows = rows.withColumn("topics", topics(F.col("sentence"))).withColumn("own", framing(F.col("sentence")))
    rows = rows.withColumn("kind", claim_kind(F.col("topics"), low)).withColumn("is_hedged", any_of(low, V.HEDGES).cast("long"))
    follows = F.rlike(F.col("sentence"), F.lit(V.LIST_ITEM)) | F.rlike(low, F.lit(V.PRONOUN_START))
    before = W.partitionBy(key).orderBy("sentence_no").rowsBetween(W.unboundedPreceding, -1)
    led = F.last(F.when(F.size(F.array_remove("own", "SYSTEM")) > 0, F.array_remove("own", "SYSTEM")), ignorenulls=True).over(before)
    bare = F.size(F.array_remove("own", "SYSTEM")) == 0
    rows = rows.withColumn("framing", F.when(bare & follows, F.array_sort(F.array_union("own", F.coalesce(led, F.col("own"))))).otherwise(F.col("own")))
    return rows.filter((F.size("topics") > 0) & ~F.endswith(F.rtrim(F.col("sentence")), F.lit("?"))).select(key, "sentence_no", "sentence", "topics", "kind", "framing", "is_hedged")


def numbers(text: Column) -> Column:
    """Numbers of a text after its phase names are gone, as written."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), V.PHASE_IN_QUESTION, " "), F.lit(V.NUMBER), F.lit(0))


def canonical(number: Column) -> Column:
    """Comma as dot, the typographic minus as hyphen."""
    return F.translate(number, ",−", ".-")


def grounding(answers: DataFrame, answer: str, context: str) -> DataFrame:
    """Adds checked, ungrounded and is_grounded: numbers of the answer, and those that the context neither has in canonical form nor contains as written. 0 to 3 are never held against an answer."""
    known = F.transform(numbers(F.col(context)), canonical)
    said = numbers(F.col(answer))
    small = F.array(*[F.lit(x) for x in "0123"])
    missing = F.filter(said, lambda x: ~F.array_contains(small, x) & ~F.array_contains(known, canonical(x)) & ~F.contains(F.coalesce(F.col(context), F.lit("")), x))
    rows = answers.withColumn("checked", said).withColumn("ungrounded", missing)
    return rows.withColumn("is_grounded", (F.size("ungrounded") == 0).cast("long"))


def transition_claims(text: Column) -> Column:
    """Ordered pairs (from, to) of phases, lower case, that a text joins by an arrow, a dash or a word of direction, or by `et`/`and` shortly after `entre`."""
    text = F.coalesce(text, F.lit(""))
    token = V.PHASE_IN_QUESTION.removeprefix("(?i)")
    joined = rf"(?iu)({token})(?=\s*(?:->|→|vers|à|a|-)\s*({token}))"
    between = rf"(?iu)entre.{{0,20}}?({token})\s*(?:et|and)\s*({token})"

    def groups(pattern: str) -> list[Column]:
        return [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2)]

    def pairs(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(F.lower(x).alias("from"), F.lower(y).alias("to")))

    return F.concat(pairs(*groups(joined)), pairs(*groups(between)))


def unsupported_transitions(answers: DataFrame, answer: str, events: DataFrame, key: str) -> DataFrame:
    """key, from, to of claimed transitions that the key's events (key, from, to as phase names) do not have. Both sides are compared in lower case."""
    said = answers.select(key, F.explode(transition_claims(F.col(answer))).alias("c")).select(key, "c.from", "c.to").distinct()
    real = events.select(key, F.lower("from").alias("from"), F.lower("to").alias("to")).distinct()
    return said.join(real, [key, "from", "to"], "left_anti")


def claims_skip(text: Column) -> Column:
    return any_of(folded(text), V.SKIP_MARKERS)


def provenance_mismatch(found: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Claims (key, sentence_no, sentence, framing) that name a phase which only another class of source has: reason.

    sources: key, class, token (lower case). A claim framed as observed may name observed phases, one framed as the model's
    the model's; a bare claim may name any that some class has.
    """
    token = F.transform(F.regexp_extract_all("sentence", F.lit(V.PHASE_IN_ANSWER), F.lit(0)), F.lower)
    rows = found.select(key, "sentence_no", "framing", F.explode(F.array_distinct(token)).alias("token"))
    have = sources.groupBy(key, "token").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    rows = rows.join(have, [key, "token"], "left")
    named = F.filter("framing", lambda f: f.isin("OBSERVED", "MODEL_DERIVED"))
    reason = F.when(F.col("classes").isNull(), "phase in no source").when((F.size(named) > 0) & ~F.arrays_overlap(named, "classes"), "phase of another source")
    return rows.withColumn("reason", reason).filter("reason is not null").select(key, "sentence_no", "token", "reason")


#: Severities of statuses, the worst last.
STATUSES = ("SUPPORTED", "HEDGED", "OUT_OF_SCOPE", "NOT_SUPPORTED", "CONTRADICTED")


def rules(found: DataFrame) -> list[tuple[str, Column, str]]:
    """(rule, condition, status) in order of evaluation, over claims with `has_observed` and `has_model` (whether the context has such sources)."""
    kind, hedged = F.col("kind"), F.col("is_hedged") == 1

    def framed(name: str) -> Column:
        return F.array_contains("framing", name)

    return [
        ("R1_observed_without_source", framed("OBSERVED") & ~F.col("has_observed"), "NOT_SUPPORTED"),
        ("R2_model_without_source", framed("MODEL_DERIVED") & ~F.col("has_model"), "NOT_SUPPORTED"),
        ("R3_prediction_as_observation", (kind == "PREDICTION_STATEMENT") & framed("OBSERVED") & ~framed("MODEL_DERIVED"), "CONTRADICTED"),
        ("R4_causal", (kind == "CAUSAL_CLAIM") & ~hedged, "NOT_SUPPORTED"),
        ("R5_clinical", kind == "CLINICAL_IMPLICATION", "OUT_OF_SCOPE"),
        ("R6_verdict_without_reference", (kind == "COMPATIBILITY_VERDICT") & ~framed("SCIENTIFIC") & ~hedged, "NOT_SUPPORTED"),
        ("R7_definition_without_reference", (kind == "DEFINITION") & ~framed("SCIENTIFIC") & ~hedged, "NOT_SUPPORTED"),
        ("R8_biology_without_reference", (kind == "ASSOCIATION") & ~framed("SCIENTIFIC") & ~hedged, "NOT_SUPPORTED"),
        ("R9_unit_of_time", (kind == "TIMING_REFERENCE") & F.rlike("sentence", F.lit(r"(?i)\d\s*(?:h|heures?|hours?|min)\b")) & ~framed("SCIENTIFIC"), "NOT_SUPPORTED"),
        ("R10_hedged", hedged, "HEDGED"),
    ]


def verdicts(found: DataFrame) -> DataFrame:
    """Adds status and rule: the worst status of all rules that hold, the first of them on ties; SUPPORTED if none does."""
    fired = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(STATUSES.index(status)).alias("severity"), F.lit(-k).alias("order"), F.lit(name).alias("rule"))) for k, (name, cond, status) in enumerate(rules(found))]))
    worst = F.array_max(fired)
    names = F.array(*[F.lit(s) for s in STATUSES])
    return found.withColumn("status", F.coalesce(F.get(names, worst["severity"]), F.lit(STATUSES[0]))).withColumn("rule", worst["rule"])


def report(judged: DataFrame, key: str) -> DataFrame:
    """key, n_claims, n_violations, has_violation, worst and the qualification appended to an answer, which itself is never altered."""
    bad = F.col("status").isin("NOT_SUPPORTED", "CONTRADICTED", "OUT_OF_SCOPE")
    names = F.array(*[F.lit(s) for s in STATUSES])
    worst = F.max(F.array_position(names, F.col("status")))
    out = judged.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(bad).alias("n_violations"), worst.alias("_w"), F.array_sort(F.collect_set(F.when(bad, F.col("rule")))).alias("broken"))
    note = F.when(F.size("broken") > 0, F.concat(F.lit("Not confirmed: "), F.array_join("broken", ", ")))
    return out.select(key, "n_claims", "n_violations", (F.col("n_violations") > 0).cast("long").alias("has_violation"), F.get(names, (F.col("_w") - 1).cast("int")).alias("worst"), note.alias("qualification"))


def confidence(n_checked: Column, n_ungrounded: Column) -> Column:
    return F.when(n_checked == 0, "unknown").when(n_ungrounded == 0, "high").when(n_ungrounded * 2 <= n_checked, "medium").otherwise("low")
