"""Registered queries of lookups, tools and contexts, with their SQL. Questions are the conversations' turns, each followed by a line of ASKED."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.functions import vocabulary as V
from phaseloom.operators import serving, tools, trajectory
from phaseloom.plans.catalog import frames, query, rounded
from phaseloom.session import PHASES, checkpointed, table

#: Lines that turns are given one of, so that each tool is called and each category has rows.
ASKED = (
    "Quelle est la phase actuelle de cette video ?", "Pourquoi le modèle prédit cette phase ?", "Depuis combien de temps dure la phase actuelle ?",
    "Quelle a été la dernière transition de cette video ?", "Quelle transition est visible dans cette fenetre ?", "La phase est-elle stable après la transition de cette video ?",
    "Quelle version du modèle est chargée ?", "Qu'est-ce que la phase tPNf ?", "L'ordre attendu du développement est-il compatible avec cette video, de tPB2 à t9+ ?",
    "Un clivage direct de l'embryon est-il justifié par les repères morphocinétiques ?", "Bonjour.", "Le diagnostic clinique de ce patient est-il cohérent avec le référentiel ?",
)
#: Limitation blocks, in the order in which the first items of `benchmark` stand for them; one is left out, so that it is missing.
LIMITING = sorted({b for names in V.LIMITATIONS.values() for b in names} - {"IC2025-ABSENT-01"})


def questions(spark, sf):
    """id, question, video, window, split: some without video or window, some of unknown videos, windows that are not the video's, splits that are not served."""
    conv, turn = F.col("conv_id"), F.col("turn")
    line = F.get(F.array(*[F.lit(x) for x in ASKED]), ((conv * 5 + turn) % len(ASKED)).cast("int"))
    video = F.when(turn % 7 == 3, None).otherwise(F.when(conv % 9 == 4, conv + 100000).otherwise(conv)).cast("long")
    window = F.when(turn % 5 == 4, None).otherwise(conv * 57 + turn * 4).cast("long")
    split = F.when(conv % 8 == 0, "test").when(conv % 8 == 1, "other").when(conv % 8 == 2, "TRAIN").otherwise("val")
    rows = table(spark, sf, "conversations").filter("conv_id is not null and turn is not null")
    rows = rows.select((conv * 1000 + turn).alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("question"), video.alias("video"), window.alias("window"), split.alias("split"))
    return rows.groupBy("id").agg(F.min("question").alias("question"), F.first("video").alias("video"), F.first("window").alias("window"), F.first("split").alias("split"))


def windows(spark, sf):
    return trajectory.with_window_start(trajectory.sliding_windows(frames(spark, sf)))


def sources(spark, sf):
    """Tables of the tools: posteriors are the shares of last phases among the windows of one first phase, so that SQL can say them."""
    rows = checkpointed(windows(spark, sf))
    share = trajectory.transition_matrix(rows).groupBy(F.col("first_phase").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("last_phase", "n"))), lambda x: x["n"].cast("double")).alias("n"))
    share = share.select("of", F.transform("n", lambda x: x / F.greatest(F.lit(1.0), F.aggregate("n", F.lit(0.0), lambda s, v: s + v))).alias("p"))
    posteriors = rows.join(F.broadcast(share.select(F.col("of").alias("first_frame_phase"), F.col("p").alias("filtered"))), "first_frame_phase")
    posteriors = posteriors.join(F.broadcast(share.select(F.col("of").alias("last_frame_phase"), F.col("p").alias("next_phase"))), "last_frame_phase")
    runs = checkpointed(trajectory.segments(rows, phase="last_frame_phase", order="window_start"))
    return tools.Sources(
        windows=rows, posteriors=checkpointed(posteriors.select("video", "window_start", "filtered", "next_phase")), segments=runs, events=trajectory.transition_events(runs),
        documents=table(spark, sf, "benchmark").select(F.col("item_id").alias("block_id"), "text"), model=table(spark, sf, "region").select(F.lit("regions").alias("name"), F.col("r_regionkey").cast("string").alias("version")).orderBy("r_regionkey").limit(1),
    )


@query
def window_frames(spark, sf):
    asked = questions(spark, sf).filter("video is not null").select("id", "video", F.col("window").alias("window_start"))
    return rounded(serving.window_frames(asked, windows(spark, sf), frames(spark, sf)).select("id", "first_frame", "last_frame", "error"))


@query
def window_truth_and_times(spark, sf):
    """Truth and times of asked windows; a frame's time is 20 minutes a frame, and of every ninth window nothing is known."""
    rows = windows(spark, sf)
    at = (F.col("first_frame") * 1200).cast("double")
    times = rows.filter("window_start % 9 <> 0").select("video", "window_start", at.alias("start_time"), (at + 8400).alias("end_time"), (at + 4200).alias("mid_time"), F.lit(8400.0).alias("duration"), F.lit(0).cast("long").alias("n_zero_steps"), (F.col("window_start") % 5 != 0).alias("is_complete"))
    asked = questions(spark, sf).filter("video is not null").select("id", "video", F.col("window").alias("window_start"))
    found = serving.with_times(serving.with_truth(asked, rows), times)
    return rounded(found.select("id", "truth_phase", "truth_flag", "time_start", "time_mid", F.col("time_available").cast("long").alias("time_available"), "time_unit"))


@query
def transition_context(spark, sf):
    asked = questions(spark, sf).select("id", "video", F.col("window").alias("window_start"))
    runs = trajectory.segments(windows(spark, sf), phase="last_frame_phase", order="window_start")
    found = serving.transition_context(asked, trajectory.transition_events(runs), "id")
    return rounded(found.select("id", "n_before", "n_after", F.col("last.from_phase").alias("last_from"), F.col("last.to_phase").alias("last_to"), F.col("last.window_start").alias("last_at"), F.col("next.no").alias("next_no"), F.col("next.window_start").alias("next_at")))


@query
def tool_plan(spark, sf):
    found = tools.plan(questions(spark, sf))
    return rounded(found.select("id", "category", F.array_join("called", ",").alias("called"), F.array_join(F.transform("not_called", lambda x: x["tool"]), ",").alias("not_called"), "scope"))


@query
def tool_results(spark, sf):
    found = tools.execute(tools.plan(questions(spark, sf)), sources(spark, sf))
    return rounded(found.select("id", "tool", "source_type", F.col("ok").cast("long").alias("ok"), "error_type", "error", "n_items", "value"))


@query
def question_contexts(spark, sf):
    planned = checkpointed(tools.plan(questions(spark, sf)))
    found = tools.contexts(planned, tools.execute(planned, sources(spark, sf)))
    used = F.size(F.filter("provenance", lambda p: p["status"] == "used"))
    return rounded(found.select("id", "category", F.size("documents").alias("n_documents"), F.array_join(F.array_sort(F.map_keys("dynamic")), ",").alias("dynamic"), F.array_join("warnings", " | ").alias("warnings"), used.alias("n_used"), (F.size("provenance") - used).alias("n_failed"), F.array_join("tools_called", ",").alias("tools_called")))


@query
def scientific_reference(spark, sf):
    """The first items of `benchmark` stand for the limitations; every seventh item names a pattern of cleavage."""
    item = F.col("item_id")
    block_id = F.coalesce(F.get(F.array(*[F.lit(b) for b in LIMITING]), item.cast("int")), F.concat(F.lit("B"), F.lpad(item.cast("string"), 6, "0")))
    said = F.concat(F.coalesce("text", F.lit("")), F.when(item % 7 == 0, " A direct cleavage is abnormal.").when(item % 5 == 0, " Clinical order of the embryon, hours and stage.").otherwise(""))
    return rounded(tools.scientific_reference(questions(spark, sf), table(spark, sf, "benchmark").select(block_id.alias("block_id"), said.alias("text"))))


def sql() -> dict[str, str]:
    from phaseloom.plans.oracle import _FOLD, _WINDOWS, _list, _phrases

    def cases(values) -> str:
        return " ".join(f"WHEN {i} THEN '" + x.replace("'", "''") + "'" for i, x in enumerate(values))

    asked = f"""qs AS (SELECT id, min(question) AS question, any_value(video) AS video, any_value("window") AS "window", any_value(split) AS split FROM (
        SELECT conv_id * 1000 + turn AS id, concat(coalesce(text, ''), chr(10), CASE (conv_id * 5 + turn) % {len(ASKED)} {cases(ASKED)} END) AS question,
          CASE WHEN turn % 7 = 3 THEN NULL WHEN conv_id % 9 = 4 THEN conv_id + 100000 ELSE conv_id END AS video, CASE WHEN turn % 5 = 4 THEN NULL ELSE conv_id * 57 + turn * 4 END AS "window",
          CASE conv_id % 8 WHEN 0 THEN 'test' WHEN 1 THEN 'other' WHEN 2 THEN 'TRAIN' ELSE 'val' END AS split
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY id)"""
    ws = f"""{_WINDOWS}, ws AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY first_frame) - 1 AS local_index, row_number() OVER (ORDER BY video, first_frame) - 1 AS window_start, first_frame, first_frame_phase, last_frame_phase, consistency_flag FROM w)"""
    events = """wc AS (SELECT *, CASE WHEN last_frame_phase <> lag(last_frame_phase) OVER (PARTITION BY video ORDER BY window_start) THEN 1 ELSE 0 END AS c FROM ws),
      wg AS (SELECT *, sum(c) OVER (PARTITION BY video ORDER BY window_start) AS g FROM wc),
      wr AS (SELECT video, g AS seg_no, min(last_frame_phase) AS phase, min(window_start) AS s, max(window_start) AS e, count(*) AS duration FROM wg GROUP BY 1, 2),
      we0 AS (SELECT video, phase AS f, lead(phase) OVER o AS t, e AS ws, lead(s) OVER o AS we FROM wr WINDOW o AS (PARTITION BY video ORDER BY seg_no)),
      we AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ws, we) - 1 AS no FROM we0 WHERE t IS NOT NULL)"""
    fold = _FOLD.replace("text", "question")
    hybrid, dynamic, documentary, domain = (_phrases(p) for p in (V.HYBRID_PATTERNS, V.DYNAMIC_KEYWORDS, V.DOCUMENTARY_KEYWORDS, V.DOMAIN_TERMS))
    token = V.PHASE_IN_QUESTION.replace("(?!\\w)", "(?:[^0-9A-Za-z_]|$)").replace("(?i)\\bt", "(?i)\\b(t").replace("[2-9])", "[2-9]))")
    plan = f"""{asked}, q1 AS (SELECT *, {fold} AS t FROM qs),
      q2 AS (SELECT *, CASE WHEN {hybrid} OR ({dynamic} AND {documentary}) THEN 'HYBRID' WHEN {dynamic} THEN 'DYNAMIC_DATA' WHEN {documentary} OR {domain} THEN 'DOCUMENTARY' ELSE 'UNKNOWN' END AS category FROM q1),
      q3 AS (SELECT *, category IN ('DYNAMIC_DATA', 'HYBRID') AS live, category IN ('DOCUMENTARY', 'HYBRID') AS docs, list_distinct([lower(x) FOR x IN regexp_extract_all(question, '{token}', 1)]) AS named, video IS NOT NULL AS v, "window" IS NOT NULL AS w FROM q2),
      q4 AS (SELECT *, live AND v AND w AS n1, live AND v AND (NOT w OR {_phrases(V.ELAPSED_TRIGGERS)}) AS n2, {_phrases(V.METADATA_TRIGGERS)} AS n3, live AND v AND {_phrases(V.TRANSITION_TRIGGERS)} AS n4,
        live AND v AND w AND {_phrases(V.HISTORY_TRIGGERS)} AS n5, docs AS n6, docs AND len(named) > 0 AS n7 FROM q3),
      pl AS (SELECT *, list_filter([CASE WHEN n1 THEN 'get_current_inference' END, CASE WHEN n2 THEN 'get_trajectory' END, CASE WHEN n3 THEN 'get_model_metadata' END, CASE WHEN n4 THEN 'get_transition_events' END,
          CASE WHEN n5 THEN 'get_inference_history' END, CASE WHEN n6 THEN 'retrieve_documents' END, CASE WHEN n7 THEN 'get_phase_information' END], lambda x: x IS NOT NULL) AS called,
        CASE WHEN n4 AND {_phrases(V.TRANSITION_HISTORY_TRIGGERS)} THEN 'full_history' ELSE 'current_window' END AS scope FROM q4)"""
    terms = "list_filter(list_distinct(regexp_extract_all(" + _FOLD + ", '[a-z0-9+]{3,}')), lambda x: NOT list_contains(" + _list(V.STOP_WORDS) + ", x))"
    names = _list(PHASES)

    def best(p: str) -> str:
        r = f"CAST(round(list_max({p}) * 10000) AS BIGINT)"
        return f"concat({names}[list_position({p}, list_max({p}))], '=', {r} // 10000, '.', lpad(CAST({r} % 10000 AS VARCHAR), 4, '0'))"

    def lexical(tool: str, text: str, k: int) -> str:
        return f"""SELECT p.id, '{tool}' AS tool, 'document' AS source_type, 1 AS ok, NULL AS error_type, NULL AS error, coalesce(n, 0) AS n_items, coalesce(hits, '') AS value
          FROM pl p LEFT JOIN (SELECT id, count(*) AS n, string_agg(CAST(block_id AS VARCHAR), ' ' ORDER BY rank) AS hits FROM (
            SELECT id, block_id, row_number() OVER (PARTITION BY id ORDER BY round(count(*) / (sqrt(nq) + sqrt(nb)), 4) DESC, block_id) AS rank
            FROM (SELECT id, len(t) AS nq, unnest(t) AS term FROM (SELECT id, {terms} AS t FROM ({text}))) a
            JOIN (SELECT item_id AS block_id, len(t) AS nb, unnest(t) AS term FROM (SELECT item_id, {terms} AS t FROM benchmark)) b USING (term) GROUP BY id, block_id, nq, nb) WHERE rank <= {k} GROUP BY id) h ON h.id = p.id
          WHERE list_contains(called, '{tool}')"""

    def live(tool: str, by_window: bool, answer: str) -> str:
        gone = f"""WHEN NOT vk THEN concat('unknown video ', video) {"WHEN NOT wk THEN concat('no window ', \"window\", ' of video ', video)" if by_window else ""} END"""
        return f"""SELECT id, '{tool}' AS tool, 'reporting_api' AS source_type, CAST(error IS NULL AS BIGINT) AS ok, CASE WHEN error IS NULL THEN NULL WHEN served THEN 'ToolNotFoundError' ELSE 'ToolInputError' END AS error_type, error,
            CASE WHEN error IS NULL THEN n ELSE 0 END AS n_items, CASE WHEN error IS NULL THEN said END AS value
          FROM (SELECT *, CASE WHEN NOT served THEN concat('split not served: ', split) {gone} AS error FROM ({answer}) WHERE list_contains(called, '{tool}'))"""

    known = """kn AS (SELECT *, lower(split) IN ('train', 'val') AS served, EXISTS (SELECT 1 FROM ws WHERE ws.video = pl.video) AS vk, EXISTS (SELECT 1 FROM ws WHERE ws.video = pl.video AND ws.window_start = pl."window") AS wk FROM pl),
      cn AS (SELECT a.range AS a, b.range AS b, count(ws.video) AS n FROM range(15) a CROSS JOIN range(15) b LEFT JOIN ws ON first_frame_phase = a.range AND last_frame_phase = b.range GROUP BY 1, 2),
      sh AS (SELECT a, list(n / greatest(1.0::DOUBLE, tot) ORDER BY b) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS tot FROM cn) GROUP BY a),
      po AS (SELECT ws.video, window_start, local_index, f.p AS fp, n.p AS np FROM ws JOIN sh f ON f.a = first_frame_phase JOIN sh n ON n.a = last_frame_phase)"""
    inference = live("get_current_inference", True, f"SELECT kn.*, 1 AS n, concat({best('fp')}, ' next ', {best('np')}) AS said FROM kn LEFT JOIN po ON po.video = kn.video AND po.window_start = kn.\"window\"")
    chains = live("get_trajectory", False, f"SELECT kn.*, n, said FROM kn LEFT JOIN (SELECT video, count(*) AS n, string_agg(concat({names}[phase + 1], ':', duration), ' ' ORDER BY seg_no) AS said FROM wr GROUP BY video) c ON c.video = kn.video")
    moved = live("get_transition_events", False, f"""SELECT kn.*, coalesce(n, 0) AS n, coalesce(said, '') AS said FROM kn LEFT JOIN (SELECT k.id, count(*) AS n, string_agg(concat({names}[f + 1], '->', {names}[t + 1], '@', we), ' ' ORDER BY ws, we) AS said
        FROM (SELECT id, video AS kv, "window" AS kw, scope FROM kn) k JOIN we ON we.video = kv AND (scope = 'full_history' OR kw IS NULL OR kw BETWEEN ws AND we) GROUP BY k.id) c ON c.id = kn.id""")
    course = live("get_inference_history", True, f"""SELECT kn.*, n, said FROM kn LEFT JOIN (SELECT k.id, count(*) AS n, concat(min(o.local_index - c.local_index), ' ', arg_min({best('o.fp')}, o.local_index), ' to ', max(o.local_index - c.local_index), ' ', arg_max({best('o.fp')}, o.local_index)) AS said
        FROM kn k JOIN po c ON c.video = k.video AND c.window_start = k."window" JOIN po o ON o.video = c.video AND o.local_index BETWEEN c.local_index - 5 AND c.local_index + 5 GROUP BY k.id) h ON h.id = kn.id""")
    versions = "SELECT id, 'get_model_metadata' AS tool, 'reporting_api' AS source_type, 1 AS ok, NULL AS error_type, NULL AS error, 1 AS n_items, concat('regions ', (SELECT min(r_regionkey) FROM region)) AS value FROM pl WHERE list_contains(called, 'get_model_metadata')"
    fed = f"""SELECT p.id, CASE WHEN {_phrases(V.ORDER_TRIGGERS)} AND s.id IS NOT NULL THEN concat_ws(' ', question, s.more) ELSE question END AS text
        FROM pl p LEFT JOIN (SELECT id, CASE WHEN bool_or(tool IN ('get_current_inference', 'get_inference_history')) THEN '{" ".join(x.lower() for x in PHASES)}' ELSE string_agg(lower(regexp_replace(value, '[:=>@-]', ' ', 'g')), ' ') END AS more
          FROM ok1 WHERE ok = 1 GROUP BY id) s ON s.id = p.id WHERE list_contains(called, 'retrieve_documents')"""
    named = "SELECT id, concat('phase ', named[1], ' developpement embryonnaire definition') AS text FROM pl WHERE list_contains(called, 'get_phase_information')"
    results = f"""{ws}, {plan}, {events}, {known}, ok1 AS ({inference} UNION ALL {chains} UNION ALL {moved} UNION ALL {course} UNION ALL {versions}),
      rs AS (SELECT * FROM ok1 UNION ALL {lexical("retrieve_documents", fed, 5)} UNION ALL {lexical("get_phase_information", named, 3)})"""
    topics = " ".join(f"CASE WHEN {_phrases(V.TOPICS[m], 'u')} THEN '{m}' END," for m in V.SCIENTIFIC_TOPICS).rstrip(",")
    extra = " ".join(f"WHEN '{t}' THEN {_list(w)}" for t, w in V.TOPIC_TERMS.items())
    limits = " ".join(f"WHEN '{t}' THEN {_list(w)}" for t, w in V.LIMITATIONS.items())
    science = f"""{asked}, q1 AS (SELECT id, question, regexp_replace({fold}, '(?:patient\\s+)?patient_[0-9]+\\S*', ' ', 'g') AS u, {terms.replace("text", "question")} AS own FROM qs),
      q2 AS (SELECT *, list_filter([{topics}], lambda x: x IS NOT NULL) AS tp FROM q1), q3 AS (SELECT * FROM q2 WHERE list_has_any(tp, {_list(V.SCIENTIFIC_TRIGGERS)})),
      q4 AS (SELECT id, tp, list_has_any(tp, {_list(V.CLEAVAGE_TOPICS)}) AS cl, list_distinct(list_concat(own, flatten([CASE m {extra} ELSE CAST([] AS VARCHAR[]) END FOR m IN tp]))) AS t FROM q3),
      bl AS (SELECT CASE item_id {cases(LIMITING)} ELSE concat('B', lpad(CAST(item_id AS VARCHAR), 6, '0')) END AS block_id,
        concat(coalesce(text, ''), CASE WHEN item_id % 7 = 0 THEN ' A direct cleavage is abnormal.' WHEN item_id % 5 = 0 THEN ' Clinical order of the embryon, hours and stage.' ELSE '' END) AS text FROM benchmark),
      bt AS (SELECT block_id, {_phrases(V.CLEAVAGE_NAMES, _FOLD)} AS nm, {terms} AS t FROM bl),
      sc AS (SELECT id, block_id, round(count(*) / (sqrt(nq) + sqrt(nb)) * CASE WHEN cl AND nm THEN 2.0 ELSE 1.0 END, 4) AS score
        FROM (SELECT id, cl, len(t) AS nq, unnest(t) AS term FROM q4) JOIN (SELECT block_id, nm, len(t) AS nb, unnest(t) AS term FROM bt) USING (term) GROUP BY id, block_id, nq, nb, cl, nm),
      ev2 AS (SELECT * FROM (SELECT id, block_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, block_id) AS rank FROM sc) WHERE rank <= 3),
      li AS (SELECT DISTINCT id, unnest(flatten([CASE m {limits} ELSE CAST([] AS VARCHAR[]) END FOR m IN tp])) AS block_id FROM q4)"""
    return {
        "window_frames": f"""WITH {ws}, {asked}, sp AS (SELECT video, min(window_start) AS low FROM ws GROUP BY 1)
          SELECT q.id, k.first_frame, k.first_frame + 7 AS last_frame, CASE WHEN sp.video IS NULL THEN 'unknown video' WHEN k.video IS NULL THEN 'no such window' END AS error
          FROM qs q LEFT JOIN sp ON sp.video = q.video LEFT JOIN ws k ON k.video = q.video AND k.local_index = q."window" - sp.low WHERE q.video IS NOT NULL""",
        "window_truth_and_times": f"""WITH {ws}, {asked}
          SELECT q.id, last_frame_phase AS truth_phase, consistency_flag AS truth_flag, CASE WHEN ok THEN first_frame * 1200.0::DOUBLE END AS time_start, CASE WHEN ok THEN first_frame * 1200.0::DOUBLE + 4200 END AS time_mid,
            CAST(coalesce(ok, false) AS BIGINT) AS time_available, 'unknown/unverified' AS time_unit
          FROM qs q LEFT JOIN (SELECT *, window_start % 9 <> 0 AND window_start % 5 <> 0 AS ok FROM ws) k ON k.video = q.video AND k.window_start = q."window" WHERE q.video IS NOT NULL""",
        "transition_context": f"""WITH {ws}, {asked}, {events}, k AS (SELECT video FROM we GROUP BY 1 HAVING count(*) >= 2)
          SELECT q.id, count(*) FILTER (ws <= "window") AS n_before, count(*) FILTER (ws > "window") AS n_after, arg_max(f, no) FILTER (ws <= "window") AS last_from, arg_max(t, no) FILTER (ws <= "window") AS last_to,
            max(ws) FILTER (ws <= "window") AS last_at, min(no) FILTER (ws > "window") AS next_no, min(ws) FILTER (ws > "window") AS next_at
          FROM qs q JOIN we ON we.video = q.video JOIN k ON k.video = q.video WHERE "window" IS NOT NULL GROUP BY q.id""",
        "tool_plan": f"""WITH {plan} SELECT id, category, array_to_string(called, ',') AS called, scope, array_to_string(list_filter([CASE WHEN NOT n1 AND NOT (live AND v AND NOT w) THEN 'get_current_inference' END, CASE WHEN NOT n2 THEN 'get_trajectory' END,
            CASE WHEN NOT n3 THEN 'get_model_metadata' END, CASE WHEN NOT n4 THEN 'get_transition_events' END, CASE WHEN NOT n5 THEN 'get_inference_history' END, CASE WHEN NOT n6 THEN 'retrieve_documents' END, CASE WHEN NOT n7 THEN 'get_phase_information' END], lambda x: x IS NOT NULL), ',') AS not_called FROM pl""",
        "tool_results": f"WITH {results} SELECT id, tool, source_type, CAST(ok AS BIGINT) AS ok, error_type, error, CAST(n_items AS BIGINT) AS n_items, value FROM rs",
        "question_contexts": f"""WITH {results}, wn AS (SELECT *, CASE WHEN ok = 0 THEN concat(tool, ' failed (', error_type, '): ', error) WHEN tool = 'get_phase_information' THEN 'get_phase_information is a text search, not a glossary of phases' END AS warning FROM rs)
          SELECT pl.id, category, count(*) FILTER (ok = 1 AND source_type = 'document') AS n_documents, coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (ok = 1 AND source_type = 'reporting_api'), '') AS dynamic,
            coalesce(string_agg(warning, ' | ' ORDER BY list_position(called, tool)) FILTER (warning IS NOT NULL), '') AS warnings, count(*) FILTER (ok = 1) AS n_used, count(*) FILTER (ok = 0) AS n_failed, array_to_string(any_value(called), ',') AS tools_called
          FROM pl LEFT JOIN wn ON wn.id = pl.id GROUP BY pl.id, category""",
        "scientific_reference": f"""WITH {science} SELECT id, 'evidence' AS role, block_id, score, rank FROM ev2 UNION ALL
          SELECT id, CASE WHEN block_id IN (SELECT block_id FROM bl) THEN 'limitation' ELSE 'missing' END AS role, block_id, NULL AS score, NULL AS rank FROM li ANTI JOIN ev2 USING (id, block_id)""",
    }
