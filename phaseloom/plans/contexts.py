"""Registered queries about contexts, claims and comparisons of models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.operators import audit, contexts, grounding, metrics, trajectory, validation
from phaseloom.plans.catalog import _centroids, dialogue, frames, predictions, query, rounded
from phaseloom.session import table

#: Classes of rendered lines by the beginnings of their paths.
PREFIXES = {"derived": ("series.", "gap."), "reference": ("sample.",), "observed": ("truth.", "events."), "model": ("model.",)}
#: Sentences of claims: each turn of a conversation makes one of them, so that each rule of validation has rows.
CLAIMS = (
    "La phase dominante juste avant etait t7.", "L'annotation montre la transition t7 -> t8.", "Le modele predit un saut de phase.", "Le decalage est de 2 fenetres pour la phase.",
    "Il s'agit d'un clivage direct.", "Il n'y a pas eu de clivage.", "La duree depuis l'ICSI compte.", "La transition dure 43,1 heures.", "Le timing est atypique.",
    "La phase est compatible avec les reperes morphocinetiques.", "Il y a des retours vers la phase.", "Le diagnostic est bon.", "La phase provoque un saut.",
    "La phase est compatible, ce qui confirme tout.", "Le modele predit une phase compatible.", "La phase de l'embryon indique une bonne qualite.", "Le referentiel place la phase ici.", "Le modele predit la phase t7.",
)


@query
def validated_claims(spark, sf):
    """Rows only, as it rests on the extracted claims; a test holds every rule against made sentences."""
    turns = dialogue(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    said = turns.withColumn("text", F.get(F.array(*[F.lit(c) for c in CLAIMS]), (F.hash("id") % len(CLAIMS) + len(CLAIMS)).cast("int") % len(CLAIMS)))
    facts = turns.select("id", F.lit("unknown/unverified").alias("time_unit"), F.lit(True).alias("lag_printed"), F.lit(None).cast("double").alias("lag"), F.lit(True).alias("returns_printed"), F.lit(0).alias("n_returns")).distinct()
    phases = turns.select("id", F.explode(F.array(F.struct(F.lit("t7").alias("phase"), F.lit("MODEL_DERIVED").alias("class")), F.struct(F.lit("t4").alias("phase"), F.lit("OBSERVED").alias("class")))).alias("x")).select("id", "x.*")
    pair = F.when(F.col("id") % 2 == 0, F.struct(F.lit("t7").alias("from"), F.lit("t8").alias("to"), F.lit("MODEL_DERIVED").alias("class"))).otherwise(F.struct(F.lit("t4").alias("from"), F.lit("t6").alias("to"), F.lit("OBSERVED").alias("class")))
    moves = turns.select("id", pair.alias("x")).select("id", "x.*")
    judged = validation.judged(grounding.claims(said, "text", "id"), validation.contexts(facts, phases, moves, "id"), "id")
    return judged.groupBy("status", "rule", "reason", "provenance").agg(F.count(F.lit(1)).alias("n"))


def trees(spark, sf, changed: bool):
    """Customers as JSON trees; `changed` has other values, shorter lists and further keys for some."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    n = F.when((F.col("c_custkey") % 3 == 0) & F.lit(changed), F.lit("99")).otherwise(nation)
    tags = F.when((F.col("c_custkey") % 4 == 0) & F.lit(changed), F.concat(F.lit('["'), F.col("c_mktsegment"), F.lit('"]'))).otherwise(F.concat(F.lit('["'), F.col("c_mktsegment"), F.lit('",'), nation, F.lit("]")))
    more = F.when((F.col("c_custkey") % 5 == 0) & F.lit(changed), F.lit(',"new":true')).otherwise("")
    text = F.concat(F.lit('{"id":'), key, F.lit(',"name":"'), F.col("c_name"), F.lit('","tags":'), tags, F.lit(',"more":{"n":'), n, F.lit(',"x":null'), more, F.lit("}}"))
    return table(spark, sf, "customer").select("c_custkey", text.alias("tree"))


@query
def tree_leaves(spark, sf):
    return audit.json_leaves(trees(spark, sf, True), "c_custkey", "tree").groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query
def tree_differences(spark, sf):
    return audit.json_diff(trees(spark, sf, False), trees(spark, sf, True), "c_custkey", "tree")


@query
def line_classes(spark, sf):
    kinds = F.array(*[F.lit(p) for p in ("series.a", "gap.max", "sample.id", "truth.phase", "events.n", "model.p", "user")])
    line = F.concat(F.get(kinds, (F.col("event_id") % 7).cast("int")), F.lit(" = "), F.col("event_type"))
    return table(spark, sf, "events").groupBy(contexts.line_class(line, PREFIXES).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def curated_chunks(spark, sf):
    ranked = table(spark, sf, "documents").select("source", (F.col("doc_id") + 1).alias("rank"), F.col("lang"))
    return contexts.curated(ranked, "source", F.when(F.col("lang") == "fr", "language"), 5)


@query
def first_ordered_mention(spark, sf):
    rows = table(spark, sf, "documents").select("source", F.col("doc_id").alias("rank"), "text")
    return contexts.first_rank(rows, "source", contexts.in_order(F.col("text"), ("a", "th", "on"), ("ne", "zz")))


@query
def enriched_questions(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("Q "), F.col("role"), F.when(F.col("turn") % 2 == 0, " Référentiel ?").otherwise("")).alias("q"), F.when(F.col("conv_id") % 3 > 0, F.array(F.lit("t2"), F.lit("t4"), F.lit("t2"))).alias("phases"))
    return contexts.enriched(rows, "q", "phases", ("referentiel", "ordre attendu")).groupBy("search_text").agg(F.count(F.lit(1)).alias("n"))


@query
def observed_only_series(spark, sf):
    both = frames(spark, sf).withColumn("model_phase", F.floor(F.col("value") / 50).cast("long"))
    return rounded(contexts.one_side(both, ["video", "frame"], ["phase"]).groupBy("video").agg(F.count_if("changed").alias("n_changes"), F.max("frame").alias("n_frames")))


@query
def model_only_series(spark, sf):
    both = frames(spark, sf).withColumn("model_phase", F.floor(F.col("value") / 50).cast("long"))
    return rounded(contexts.one_side(both, ["video", "frame"], ["model_phase"]).groupBy("video").agg(F.count_if("changed").alias("n_changes"), F.max("frame").alias("n_frames")))


@query
def provenance_table(spark, sf):
    tokens = frames(spark, sf).select("video", F.when(F.col("frame") % 3 == 0, "OBSERVED").when(F.col("frame") % 3 == 1, "MODEL_DERIVED").alias("class"), F.concat(F.lit("t"), F.col("phase")).alias("token"))
    rows = contexts.provenance(tokens, "video")
    return rounded(rows.select("video", "class", F.array_join("tokens", ",").alias("tokens"), "n"))


@query
def rendered_history(spark, sf):
    rows = frames(spark, sf).select("video", "frame", "phase", F.when(F.col("frame") % 4 > 0, F.floor(F.col("value") * 8) / 8).alias("score"))
    return contexts.rendered(rows)


@query
def allowed_leaves(spark, sf):
    """Leaves of the events' JSON; only `k` is allowed, and a wrapped copy of it is not."""
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"x": '), F.col("props"), F.lit("}"))).alias("props"))
    return contexts.allowed_only(rows, "event_id", "props", ("k",)).groupBy("path", "is_kept").agg(F.count(F.lit(1)).alias("n"))


@query
def paired_contexts(spark, sf):
    """Full contexts against filtered ones: every fifth differs in its type, every seventh holds what must not be there, some are missing."""
    full = table(spark, sf, "events").filter("event_id is not null").select("event_id", "event_type", "props")
    part = full.filter("event_id % 11 > 0").select("event_id", F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", r"\}$", ', "model": 1}')).otherwise(F.col("props")).alias("props"))
    audit = contexts.paired_audit(full, part, "event_id", ["event_type"], "props", ["model"])
    return audit.groupBy(*[F.col(c).cast("long").alias(c) for c in ("same_event_type", "same_payload", "n_leaks", "passed")]).agg(F.count(F.lit(1)).alias("n"))


@query
def routed_category_accuracy(spark, sf):
    routed = grounding.route(dialogue(spark, sf), "text").withColumn("expected", F.when(F.col("turn") % 2 == 0, "DYNAMIC_DATA").otherwise("DOCUMENTARY"))
    return rounded(metrics.category_accuracy(routed, "expected", "category"))


@query
def window_outcomes(spark, sf):
    windows = trajectory.sliding_windows(frames(spark, sf))
    rows = windows.select(F.col("consistency_flag").alias("actual"), (F.col("first_frame") % 4 == 0).cast("long").alias("predicted"), "first_frame_phase", "last_frame_phase")
    return rounded(metrics.outcomes_by_pair(rows, "first_frame_phase", "last_frame_phase"))


@query
def phase_calibration_durations(spark, sf):
    durations = trajectory.duration_stats(trajectory.segments(frames(spark, sf))).select("phase", F.col("mean").alias("mean_duration"))
    stats = predictions(spark, sf).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"))
    return rounded(metrics.joined_by_phase(stats, durations, "phase"))


@query
def configuration_grid(spark, sf):
    rows = predictions(spark, sf).select(F.col("prob").alias("first"), ((F.col("doc_id") % 10) / 10).alias("second"), "label")
    return rounded(metrics.config_grid(rows, [0.5, 1.0, 2.0], [0.0, 0.25]))


@query
def ladder_pairs(spark, sf):
    briers = predictions(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), ((p - F.col("label")) * (p - F.col("label"))).alias("b")) for m, p in (("base_rate", F.lit(0.5)), ("persistence", F.col("prob")), ("constant", F.lit(0.25)))])).alias("x")).select("x.*")
    results = briers.groupBy("model").agg(F.avg("b").alias("brier"))
    return rounded(metrics.ladder_comparisons(results, [("persistence", "base_rate"), ("constant", "persistence"), ("missing", "base_rate")], "brier"))


def sql() -> dict[str, str]:
    from phaseloom.plans.oracle import _AUROC, _FRAMES, _PREDS, _SEGMENTS, _WINDOWS

    def one_side(column: str) -> str:
        return f"""WITH {_FRAMES}, m AS (SELECT video, frame, phase, CAST(floor(value / 50) AS BIGINT) AS model_phase FROM f), k AS (SELECT video, frame, {column} <> lag({column}) OVER (PARTITION BY video ORDER BY frame) AS c FROM m)
            SELECT video, count(*) FILTER (c) AS n_changes, max(frame) AS n_frames FROM k GROUP BY 1"""

    def tree(changed: str) -> str:
        return f"""concat('{{"id":', c_custkey, ',"name":"', c_name, '","tags":["', c_mktsegment, '"', CASE WHEN {changed} AND c_custkey % 4 = 0 THEN '' ELSE concat(',', c_nationkey) END, '],"more":{{"n":',
          CASE WHEN {changed} AND c_custkey % 3 = 0 THEN '99' ELSE CAST(c_nationkey AS VARCHAR) END, ',"x":null', CASE WHEN {changed} AND c_custkey % 5 = 0 THEN ',"new":true' ELSE '' END, '}}}}')"""

    def leaves(name: str, changed: str) -> str:
        return f"""{name} AS (SELECT c_custkey, replace(substr(t.fullkey, 3), '"', '') AS path, CASE WHEN t.type = 'NULL' THEN 'null' ELSE CAST(t.atom AS VARCHAR) END AS value
          FROM (SELECT c_custkey, CAST({tree(changed)} AS JSON) AS j FROM customer) c, json_tree(c.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"""

    return {
        "tree_leaves": f"WITH {leaves('a', 'true')} SELECT path, count(*) AS n, count(DISTINCT value) AS n_values FROM a GROUP BY path",
        "tree_differences": f"""WITH {leaves('a', 'false')}, {leaves('b', 'true')} SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.path, b.path) AS path, coalesce(a.value, '<absent>') AS "left", coalesce(b.value, '<absent>') AS "right"
          FROM a FULL JOIN b ON a.c_custkey = b.c_custkey AND a.path = b.path WHERE coalesce(a.value, '<absent>') <> coalesce(b.value, '<absent>')""",
        "line_classes": """WITH k AS (SELECT ['series.a', 'gap.max', 'sample.id', 'truth.phase', 'events.n', 'model.p', 'user'][event_id % 7 + 1] AS p FROM events)
            SELECT CASE WHEN p LIKE 'series.%' OR p LIKE 'gap.%' THEN 'derived' WHEN p LIKE 'sample.%' THEN 'reference' WHEN p LIKE 'truth.%' OR p LIKE 'events.%' THEN 'observed' WHEN p LIKE 'model.%' THEN 'model' ELSE 'identifiers' END AS class, count(*) AS n FROM k GROUP BY 1""",
        "curated_chunks": """WITH k AS (SELECT source, doc_id + 1 AS rank, lang, CASE WHEN lang = 'fr' THEN 'language' END AS rule FROM documents), n AS (SELECT *, count(*) FILTER (rule IS NULL) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS free FROM k)
            SELECT source, rank, lang, rule, CASE WHEN rule IS NOT NULL THEN 'skipped' WHEN free <= 5 THEN 'kept' ELSE 'not_needed' END AS decision FROM n""",
        "first_ordered_mention": """WITH k AS (SELECT source, doc_id, text, instr(text, 'a') AS a, instr(text, 'th') AS b, instr(text, 'on') AS c FROM documents)
            SELECT source, min(CASE WHEN a > 0 AND b > a AND c > b AND (contains(substr(text, c), 'ne') OR contains(substr(text, c), 'zz')) THEN doc_id END) AS rank FROM k GROUP BY 1""",
        "enriched_questions": """WITH k AS (SELECT 'Q ' || role || CASE WHEN turn % 2 = 0 THEN ' Référentiel ?' ELSE '' END AS q, turn % 2 = 0 AND conv_id % 3 > 0 AS adds FROM conversations)
            SELECT CASE WHEN adds THEN q || ' t2 t4' ELSE q END AS search_text, count(*) AS n FROM k GROUP BY 1""",
        "observed_only_series": one_side("phase"),
        "model_only_series": one_side("model_phase"),
        "provenance_table": f"""WITH {_FRAMES}, k AS (SELECT video, CASE frame % 3 WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'MODEL_DERIVED' END AS class, 't' || phase AS token FROM f)
            SELECT video, class, string_agg(DISTINCT token, ',' ORDER BY token) AS tokens, count(*) AS n FROM k WHERE class IS NOT NULL GROUP BY 1, 2""",
        "rendered_history": f"""WITH {_FRAMES} SELECT video, frame, 'W' || frame || ' ' || phase || CASE WHEN frame % 4 > 0 THEN ' p=' || printf('%.3f', floor(value * 8) / 8) ELSE '' END AS line FROM f""",
        "allowed_leaves": "SELECT CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'x.k' END AS path, event_id % 2 = 0 AS is_kept, count(*) AS n FROM events GROUP BY 1, 2",
        "paired_contexts": """WITH k AS (SELECT event_id, event_id % 11 > 0 AS there, event_id % 7 = 0 AS leaks, event_id % 5 = 0 AS other FROM events WHERE event_id IS NOT NULL)
            SELECT CAST(there AND NOT other AS BIGINT) AS same_event_type, CAST(there AND NOT leaks AS BIGINT) AS same_payload, CAST(there AND leaks AS BIGINT) AS n_leaks, CAST(there AND NOT other AND NOT leaks AS BIGINT) AS passed, count(*) AS n FROM k GROUP BY 1, 2, 3, 4""",
        "window_outcomes": f"""WITH {_WINDOWS}, k AS (SELECT consistency_flag AS actual, CAST(first_frame % 4 = 0 AS BIGINT) AS predicted, first_frame_phase, last_frame_phase FROM w)
            SELECT actual, predicted, CAST(actual = predicted AS BIGINT) AS is_right, first_frame_phase, last_frame_phase, count(*) AS n FROM k GROUP BY 1, 2, 3, 4, 5""",
        "phase_calibration_durations": f"""WITH {_SEGMENTS}, {_PREDS}, d AS (SELECT phase, avg(duration) AS mean_duration FROM s GROUP BY 1), k AS (SELECT phase, count(*) AS n, avg(prob) AS mean_prob FROM p GROUP BY 1)
            SELECT k.phase, n, round(mean_prob, 6) AS mean_prob, round(mean_duration, 6) AS mean_duration, CAST(mean_duration IS NULL AS BIGINT) AS is_excluded FROM k LEFT JOIN d ON k.phase = d.phase""",
        "configuration_grid": f"""WITH {_PREDS}, a(i, alpha) AS (VALUES (0, 0.5::DOUBLE), (1, 1.0), (2, 2.0)), r(j, rho) AS (VALUES (0, 0.0::DOUBLE), (1, 0.25)),
            c AS (SELECT CAST(i * 2 + j AS BIGINT) AS config_no, alpha, rho, label, (1 - rho) * pow(prob, alpha) + rho * (CAST(doc_id % 10 AS DOUBLE) / 10) AS prob FROM p, a, r),
            m AS (SELECT config_no, alpha, rho, count(*) AS n, avg((prob - label) * (prob - label)) AS brier, avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM c GROUP BY 1, 2, 3)
            SELECT m.config_no, alpha, rho, n, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, round(auroc, 6) AS auroc FROM m JOIN {_AUROC.format(k='config_no,', part='config_no', w='1', t='c', g='GROUP BY config_no')} USING (config_no)""",
        "ladder_pairs": f"""WITH {_PREDS}, b AS (SELECT avg((0.5::DOUBLE - label) * (0.5::DOUBLE - label)) AS base, avg((prob - label) * (prob - label)) AS persist, avg((0.25::DOUBLE - label) * (0.25::DOUBLE - label)) AS const FROM p)
            SELECT 'persistence' AS model, 'base_rate' AS baseline, round(persist, 6) AS value, round(base, 6) AS baseline_value, round(persist - base, 6) AS gain FROM b
            UNION ALL SELECT 'constant', 'persistence', round(const, 6), round(persist, 6), round(const - persist, 6) FROM b""",
    }
