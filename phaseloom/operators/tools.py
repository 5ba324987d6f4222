"""Reads that a question needs: planned by its words, run as views over tables, failures as typed rows, and the context that answers are built from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import vocabulary as V
from phaseloom.operators import corpus, serving
from phaseloom.operators.grounding import any_of, folded, phase_tokens, route, topics
from phaseloom.session import PHASES, SPLITS, checkpointed

# Names of the tools, in the order in which a plan lists them, and of their errors and kinds of source.
INFERENCE, TRAJECTORY, METADATA, EVENTS, HISTORY, DOCUMENTS, PHASE = (
    "get_current_inference", "get_trajectory", "get_model_metadata", "get_transition_events", "get_inference_history", "retrieve_documents", "get_phase_information",
)
INPUT_ERROR, NOT_FOUND, UNAVAILABLE = "ToolInputError", "ToolNotFoundError", "ToolUnavailableError"
DOCUMENT, REPORTING = "document", "reporting_api"

RESULT = "tool string, source_type string, ok boolean, error_type string, error string, n_items long, value string"


@dataclass(frozen=True)
class Sources:
    """Tables that tools read; a tool whose table is missing is unavailable.

    windows: video, window_start, local_index, last_frame_phase, consistency_flag. posteriors: video, window_start, filtered, next_phase (arrays over phases).
    segments: video, seg_no, phase, duration. events: transitions of windows. documents: block_id, text. model: one row, name, version.
    """

    windows: DataFrame | None = None
    posteriors: DataFrame | None = None
    segments: DataFrame | None = None
    events: DataFrame | None = None
    documents: DataFrame | None = None
    model: DataFrame | None = None


def plan(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds category, phases, called (tools in order), not_called (array of tool and reason) and scope (of transitions: current_window or full_history) to questions (video, window)."""
    rows, low = questions.withColumn("_low", folded(F.col(text))), F.col("_low")
    rows = route(rows, text, "_low").drop("n_dynamic", "n_documentary", "n_domain")
    live, docs = F.col("category").isin("DYNAMIC_DATA", "HYBRID"), F.col("category").isin("DOCUMENTARY", "HYBRID")
    video, window = F.col("video").isNotNull(), F.col("window").isNotNull()
    rows = rows.withColumn("phases", F.when(docs, phase_tokens(F.col(text))).otherwise(F.array().cast("array<string>")))
    needs = [
        (INFERENCE, live & video & window, F.when(~live, "no live data is asked for").when(~video | ~window, F.when(video, "no window").otherwise("no video"))),
        (TRAJECTORY, live & video & (~window | any_of(low, V.ELAPSED_TRIGGERS)), F.when(~live, "no live data is asked for").when(~video, "no video").otherwise("one window is enough")),
        (METADATA, any_of(low, V.METADATA_TRIGGERS), F.lit("the model's version is not asked for")),
        (EVENTS, live & video & any_of(low, V.TRANSITION_TRIGGERS), F.lit("no transition is asked for, or no video")),
        (HISTORY, live & video & window & any_of(low, V.HISTORY_TRIGGERS), F.lit("no course over windows is asked for, or no window")),
        (DOCUMENTS, docs, F.lit("no documents are asked for")),
        (PHASE, docs & (F.size("phases") > 0), F.when(~docs, "no documents are asked for").otherwise("no phase is named")),
    ]
    called = F.array_compact(F.array(*[F.when(need, name) for name, need, _ in needs]))
    # With a video but no window the trajectory stands in for the inference, which is then not mentioned.
    instead = live & video & ~window
    reasons = [F.when(~need & (~instead if name == INFERENCE else F.lit(True)), F.struct(F.lit(name).alias("tool"), F.coalesce(reason, F.lit("")).alias("reason"))) for name, need, reason in needs]
    scope = F.when(any_of(low, V.TRANSITION_HISTORY_TRIGGERS), "full_history").otherwise("current_window")
    return rows.withColumns({"called": called, "not_called": F.array_compact(F.array(*reasons)), "scope": F.when(F.array_contains(called, EVENTS), scope).otherwise("current_window")}).drop("_low")


def _name(phase: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PHASES]), phase.cast("int"))


def _best(p: Column) -> Column:
    """The first of an array's largest values, as `name=value` with 4 places."""
    top = F.array_max(p)
    digits = F.round(top * 10_000).cast("long")
    value = F.concat(F.floor(digits / 10_000).cast("string"), F.lit("."), F.lpad((digits % 10_000).cast("string"), 4, "0"))
    return F.concat(_name(F.array_position(p, top) - 1), F.lit("="), value)


def _failed(rows: DataFrame, tool: str, kind: str, error_type: Column, error: Column) -> DataFrame:
    return rows.select("id", F.lit(tool).alias("tool"), F.lit(kind).alias("source_type"), F.lit(False).alias("ok"), error_type.alias("error_type"), error.alias("error"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("string").alias("value"))


def _found(rows: DataFrame, tool: str, kind: str, n: Column, value: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("id", F.lit(tool).alias("tool"), F.lit(kind).alias("source_type"), F.lit(True).alias("ok"), none.alias("error_type"), none.alias("error"), n.cast("long").alias("n_items"), value.alias("value"))


def execute(planned: DataFrame, sources: Sources, k: int = 5, k_phase: int = 3, before: int = 5, after: int = 5) -> DataFrame:
    """id, tool, source_type, ok, error_type, error, n_items, value: one row for each planned tool of each question (id, question, video, window, split).

    A failure never stops the others: a split that is unknown or kept for evaluation is a ToolInputError, a video or window that is not there a
    ToolNotFoundError, a tool without its table a ToolUnavailableError. n_items counts what was found (windows, segments, transitions, documents; 0 is an
    answer), value says it in one line. Ids of questions must be unique.

    Each tool is a view that joins the questions which call it; questions of one kind run together, and no question is looked at on the driver. Plans and
    the reporting tools' results are written to the checkpoint folder, as several views read them.
    """
    planned = checkpointed(planned)
    served = F.coalesce(F.lower("split").isin(*[s for s in SPLITS if s != "test"]), F.lit(False))
    calls = {t: planned.filter(F.array_contains("called", t)) for t in (INFERENCE, TRAJECTORY, METADATA, EVENTS, HISTORY, DOCUMENTS, PHASE)}
    out = []

    def unavailable(tool: str, kind: str, *tables: DataFrame | None) -> bool:
        if any(t is None for t in tables):
            out.append(_failed(calls[tool], tool, kind, F.lit(UNAVAILABLE), F.lit(f"{tool}: its table is missing")))
            return True
        return False

    def checked(tool: str, by_window: bool) -> DataFrame:
        """Questions whose split is served and whose video (and window) exists; the others become errors."""
        rows = calls[tool]
        out.append(_failed(rows.filter(~served), tool, REPORTING, F.lit(INPUT_ERROR), F.concat(F.lit("split not served: "), F.coalesce("split", F.lit("none")))))
        rows = rows.filter(served).join(sources.windows.select("video").distinct().withColumn("_video", F.lit(True)), "video", "left")
        there = F.col("_video").isNotNull()
        error = F.when(~there, F.concat(F.lit("unknown video "), F.col("video").cast("string")))
        if by_window:
            rows = rows.join(sources.windows.select("video", F.col("window_start").alias("window"), F.lit(True).alias("_window")), ["video", "window"], "left")
            error = F.coalesce(error, F.when(F.col("_window").isNull(), F.concat(F.lit("no window "), F.col("window").cast("string"), F.lit(" of video "), F.col("video").cast("string"))))
        rows = rows.withColumn("_error", error)
        out.append(_failed(rows.filter("_error is not null"), tool, REPORTING, F.lit(NOT_FOUND), F.col("_error")))
        return rows.filter("_error is null")

    if not unavailable(INFERENCE, REPORTING, sources.windows, sources.posteriors):
        rows = checked(INFERENCE, True).join(sources.posteriors.withColumnRenamed("window_start", "window"), ["video", "window"])
        out.append(_found(rows, INFERENCE, REPORTING, F.lit(1), F.concat(_best(F.col("filtered")), F.lit(" next "), _best(F.col("next_phase")))))
    if not unavailable(TRAJECTORY, REPORTING, sources.windows, sources.segments):
        chains = sources.segments.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("seg_no", "phase", "duration"))).alias("_chain"))
        rows = checked(TRAJECTORY, False).join(chains, "video", "left")
        said = F.array_join(F.transform("_chain", lambda s: F.concat(_name(s["phase"]), F.lit(":"), s["duration"].cast("string"))), " ")
        out.append(_found(rows, TRAJECTORY, REPORTING, F.coalesce(F.size("_chain"), F.lit(0)), F.coalesce(said, F.lit(""))))
    if not unavailable(METADATA, REPORTING, sources.model):
        rows = calls[METADATA].crossJoin(F.broadcast(sources.model.limit(1)))
        out.append(_found(rows, METADATA, REPORTING, F.lit(1), F.concat_ws(" ", "name", "version")))
    if not unavailable(EVENTS, REPORTING, sources.windows, sources.events):
        rows = checked(EVENTS, False)
        lists = sources.events.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("window_start", "window_end", "from_phase", "to_phase"))).alias("_all"))
        rows = rows.join(lists, "video", "left")
        whole = (F.col("scope") == "full_history") | F.col("window").isNull()
        own = F.coalesce(F.filter("_all", lambda e: whole | F.col("window").between(e["window_start"], e["window_end"])), F.array())
        said = F.array_join(F.transform(own, lambda e: F.concat(_name(e["from_phase"]), F.lit("->"), _name(e["to_phase"]), F.lit("@"), e["window_end"].cast("string"))), " ")
        out.append(_found(rows, EVENTS, REPORTING, F.size(own), said))
    if not unavailable(HISTORY, REPORTING, sources.windows, sources.posteriors):
        rows = checked(HISTORY, True)
        around = serving.band(rows.select("id", "video", F.col("window").alias("window_start")), sources.windows, "id", before, after)
        each = around.join(sources.posteriors, ["video", "window_start"]).select("id", F.struct("offset", _best(F.col("filtered")).alias("best")).alias("e"))
        seen = each.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("_band"))
        rows = rows.join(seen, "id", "left")
        first, last = F.get("_band", 0), F.get("_band", F.size("_band") - 1)
        said = F.concat(first["offset"].cast("string"), F.lit(" "), first["best"], F.lit(" to "), last["offset"].cast("string"), F.lit(" "), last["best"])
        out.append(_found(rows, HISTORY, REPORTING, F.coalesce(F.size("_band"), F.lit(0)), F.coalesce(said, F.lit(""))))
    out = [checkpointed(_union(out))] if out else []
    known = out[0].filter(F.col("ok") & (F.col("source_type") == REPORTING)) if out else None
    for tool, most in ((DOCUMENTS, k), (PHASE, k_phase)):
        if not unavailable(tool, DOCUMENT, sources.documents):
            if tool == DOCUMENTS:
                rows = asked = retrieval_queries(calls[tool], known)
                key = "id"
            else:  # questions of one phase ask the same, so there are as many searches as phases have names
                rows = calls[tool].withColumn("_asked", F.concat(F.lit("phase "), F.get("phases", 0), F.lit(" developpement embryonnaire definition")))
                asked, key = rows.select("_asked").distinct(), "_asked"
            ranked = corpus.lexical_topk(asked, sources.documents, most, key, "_asked", "block_id", "text")
            hits = ranked.groupBy(F.col("query_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("rank", "block_id"))).alias("_hits"))
            rows = rows.join(hits if tool == DOCUMENTS else F.broadcast(hits), key, "left")
            out.append(_found(rows, tool, DOCUMENT, F.coalesce(F.size("_hits"), F.lit(0)), F.coalesce(F.array_join(F.transform("_hits", lambda h: h["block_id"].cast("string")), " "), F.lit(""))))
    return checkpointed(_union(out))


def _union(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other)
    return both


def retrieval_queries(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Adds _asked: the question; if it asks about the order of phases, with the phases behind it that this question's reporting tools have named.

    A distribution names all phases, so where there is one all are added; else those that the tools' values name.
    """
    if known is None:
        return rows.withColumn("_asked", F.col("question"))
    spread = F.max(F.col("tool").isin(INFERENCE, HISTORY))
    named = known.groupBy("id").agg(F.when(spread, F.lit(" ".join(PHASES))).otherwise(F.array_join(F.array_sort(F.collect_set(F.array_join(phase_tokens(F.col("value")), " "))), " ")).alias("_named"))
    asks = any_of(folded(F.col("question")), V.ORDER_TRIGGERS)
    rows = rows.join(named, "id", "left")
    return rows.withColumn("_asked", F.when(asks & F.col("_named").isNotNull(), F.concat_ws(" ", "question", "_named")).otherwise(F.col("question"))).drop("_named")


def contexts(planned: DataFrame, results: DataFrame) -> DataFrame:
    """id, category, documents, dynamic, warnings, provenance, tools_called: a row for each question, whether its tools answered or not.

    Documents and live values stay apart: `documents` has tool and value of document tools, `dynamic` a map from reporting tool to value. A failed tool is a
    warning `<tool> failed (<type>): <error>` and a provenance entry of status `error`; phase information warns that it is a search and no glossary.
    """
    place = F.array_position(F.col("called"), F.col("tool"))
    rows = results.join(planned.select("id", "called"), "id")
    document, live = F.col("ok") & (F.col("source_type") == DOCUMENT), F.col("ok") & (F.col("source_type") == REPORTING)
    failed = F.concat(F.col("tool"), F.lit(" failed ("), F.col("error_type"), F.lit("): "), F.col("error"))
    warning = F.when(~F.col("ok"), failed).when(F.col("tool") == PHASE, "get_phase_information is a text search, not a glossary of phases")
    seen = rows.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(document, F.struct(place.alias("at"), "tool", "value")))).alias("_documents"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(live, F.struct("tool", "value"))))).alias("dynamic"),
        F.sort_array(F.collect_list(F.when(warning.isNotNull(), F.struct(place.alias("at"), warning.alias("said"))))).alias("_warnings"),
        F.sort_array(F.collect_list(F.struct(place.alias("at"), "tool", "source_type", F.when(F.col("ok"), "used").otherwise("error").alias("status"), "n_items"))).alias("_provenance"),
    )
    out = planned.select("id", "category", F.col("called").alias("tools_called")).join(seen, "id", "left")
    empty = F.create_map().cast("map<string,string>")
    return out.select(
        "id", "category", F.coalesce(F.transform("_documents", lambda d: F.struct(d["tool"].alias("tool"), d["value"].alias("value"))), F.array()).alias("documents"), F.coalesce("dynamic", empty).alias("dynamic"),
        F.coalesce(F.transform("_warnings", lambda w: w["said"]), F.array()).alias("warnings"),
        F.coalesce(F.transform("_provenance", lambda p: F.struct(p["tool"].alias("tool"), p["source_type"].alias("source_type"), p["status"].alias("status"), p["n_items"].alias("n_items"))), F.array()).alias("provenance"), "tools_called",
    )


def scientific_reference(questions: DataFrame, blocks: DataFrame, k: int = 3, text: str = "question") -> DataFrame:
    """id, role, block_id, score, rank: for questions about a subject of the reference, its k best blocks as `evidence`, then the limitations that go with the subjects.

    A question's terms and those of its subjects meet a block's terms; the score is the number shared over the sum of the roots of both sizes, twice that for a block
    that names a pattern of cleavage if the question is about one, to 4 places; ties go to the smaller id. A limitation that is evidence already is not listed
    again; one that the blocks (block_id, text) lack is `missing`. Questions that ask about none of the subjects have no rows.

    Questions are read once: their terms and the evidence are written to the checkpoint folder, as both are read twice.
    """
    found = topics(F.col(text))
    rows = questions.select("id", F.col(text).alias("_text"), F.filter(found, lambda m: m.isin(*V.SCIENTIFIC_TOPICS)).alias("_topics"))
    rows = rows.filter(F.arrays_overlap("_topics", F.array(*[F.lit(t) for t in V.SCIENTIFIC_TRIGGERS])))
    extra = F.create_map(*[x for t, words in V.TOPIC_TERMS.items() for x in (F.lit(t), F.array(*[F.lit(w) for w in words]))])
    more = F.flatten(F.transform("_topics", lambda t: F.coalesce(F.try_element_at(extra, t), F.array().cast("array<string>"))))
    rows = rows.withColumn("_terms", F.array_union(corpus.terms(F.col("_text")), more))
    rows = rows.withColumn("_cleavage", F.arrays_overlap("_topics", F.array(*[F.lit(t) for t in V.CLEAVAGE_TOPICS])))
    rows = checkpointed(rows.drop("_text"))
    own = blocks.select("block_id", corpus.terms(F.col("text")).alias("_own"), any_of(folded(F.col("text")), V.CLEAVAGE_NAMES).alias("_names"))
    own = own.select("block_id", "_names", F.size("_own").alias("_nb"), F.explode("_own").alias("_term"))
    pairs = rows.select("id", "_cleavage", F.size("_terms").alias("_nq"), F.explode("_terms").alias("_term")).join(own, "_term")
    scored = pairs.groupBy("id", "block_id", "_nq", "_nb", "_cleavage", "_names").agg(F.count("*").alias("_shared"))
    weight = F.when(F.col("_cleavage") & F.col("_names"), 2.0).otherwise(1.0)
    scored = scored.select("id", "block_id", F.round(F.col("_shared") / (F.sqrt("_nq") + F.sqrt("_nb")) * weight, 4).alias("score"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "block_id")).cast("long")
    evidence = checkpointed(scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", F.lit("evidence").alias("role"), "block_id", "score", "rank"))
    limits = F.create_map(*[x for t, names in V.LIMITATIONS.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])
    wanted = rows.select("id", F.explode(F.array_distinct(F.flatten(F.transform("_topics", lambda t: F.coalesce(F.try_element_at(limits, t), F.array().cast("array<string>")))))).alias("block_id"))
    wanted = wanted.join(evidence.select("id", "block_id"), ["id", "block_id"], "left_anti").join(blocks.select("block_id", F.lit(True).alias("_there")).distinct(), "block_id", "left")
    role = F.when(F.col("_there"), "limitation").otherwise("missing")
    return evidence.unionByName(wanted.select("id", role.alias("role"), "block_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("rank")))
