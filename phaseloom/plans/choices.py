"""Registered queries that choose between state models, and the audit of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.operators import hmm, metrics, scan, selection, semimarkov
from phaseloom.operators.requirements import Requirements, audit
from phaseloom.plans.catalog import frames, query, rounded
from phaseloom.plans.states import by_value
from phaseloom.session import table

#: What the audit asks of documents that have been given lines of metadata, of a reference and of a time.
RULES = Requirements(
    min_chars=300, metadata=("document_id", "language", "source_sha256"), expected={"language": "en"}, fragments={"sections_missing": ("## Reference", "the", "no such section"), "guards_missing": ("are medians, not ranges",)},
    identifiers={"gaps_missing": (r"\bKG-\d{2}\b", 12), "limits_missing": (r"\bLIM-\d{2}\b", 2)}, pages=47, tables=11, figures=1, forbidden={"definitions": (r"\bthe\s+the\b", "is defined as"), "overclaims": (r"\bproves\b",)},
    timed=("tM", "tEB"), unit="hpi|%", medians=((23, 24), (89, 91), (113, 113)),
)


def state_changes(spark, sf):
    """video, frame, label, hmm, semi_hmm, base_rate of odd videos: whether the phase changed and what models of even videos, which see values alone, expected; to 6 decimals."""
    train, asked = by_value(spark, sf)
    log_pi, log_a = hmm.parameters(train)
    first = scan.decode(asked, log_pi, log_a, k=3, rate=0.2, smooth=False).select("video", "frame", F.round("change_prob", 6).alias("hmm"))
    second = semimarkov.decode(asked, semimarkov.fit(train, family="empirical"), k=3, rate=0.2).select("video", "frame", F.round("change_prob", 6).alias("semi_hmm"))
    rate = selection.changes(train).agg(F.round(F.avg("label"), 6).alias("base_rate"))
    truth = selection.changes(frames(spark, sf).filter("video % 2 = 1")).filter("label is not null")
    return truth.join(first, ["video", "frame"]).join(second, ["video", "frame"]).join(F.broadcast(rate))


@query
def state_ladder(spark, sf):
    """Both state models and the base rate on the same frames."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in ("base_rate", "hmm", "semi_hmm")])).alias("x")
    return rounded(selection.scored(state_changes(spark, sf).select("label", each).select("label", "x.*"), ["model"]))


@query
def video_deltas(spark, sf):
    rows = state_changes(spark, sf).select("video", "label", F.col("hmm").alias("a"), F.col("semi_hmm").alias("b"))
    return rounded(selection.video_deltas(rows))


@query
def paired_tests(spark, sf):
    """What SQL can say of the paired tests of videos; the p-values of the t and signed-rank tests are in `paired_test_p`."""
    rows = state_changes(spark, sf).select("video", "label", F.col("hmm").alias("a"), F.col("semi_hmm").alias("b"))
    return rounded(selection.paired_tests(selection.video_deltas(rows)).drop("ttest_p", "wilcoxon_p"))


@query
def paired_test_p(spark, sf):
    """Rows only: the distributions of the statistics are held against enumeration and known quantiles in tests."""
    rows = state_changes(spark, sf).select("video", "label", F.col("hmm").alias("a"), F.col("semi_hmm").alias("b"))
    return rounded(selection.paired_tests(selection.video_deltas(rows)).select("n", "sign_p", "ttest_p", "wilcoxon_p"))


@query
def hmm_sweep(spark, sf):
    """Rows only: each setting is fitted and decoded anew, held against single fits in tests; the chosen setting has rank 1."""
    train, asked = by_value(spark, sf)
    grid = selection.hmm_sweep(train, asked, frames(spark, sf).filter("video % 2 = 1"), [0.5, 2.0], [0.3, 0.5, 0.8], k=7)
    chosen = metrics.select_config(grid, 0.5).select("config_no", "rank", "reason")
    return rounded(grid.join(chosen, "config_no"))


@query
def corpus_audit(spark, sf):
    """Documents under lines of metadata made from their own columns; every ninth declares another hash, one in fifty is also listed elsewhere."""
    docs = table(spark, sf, "documents").filter("doc_id is not null")
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    lines = [
        F.concat(F.lit("- **document_id (own):** "), n.cast("string")), F.concat(F.lit("- **source_sha256:** `"), F.when(n % 9 == 0, "none").otherwise(F.sha2(text, 256)), F.lit("`")),
        F.when(n % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("- **language:** "), F.coalesce("lang", F.lit("")))), F.lit("## Reference 12 tM"),
        F.concat(F.lit("> KG-"), F.lpad((n % 12).cast("string"), 2, "0"), F.lit(" Table "), (n % 15).cast("string"), F.lit(", pp. "), (n % 60).cast("string"), F.lit("-"), (n % 50).cast("string")),
        F.concat(F.lit("> tM "), (n % 130).cast("string"), F.when(n % 4 == 0, " - 91 hpi").otherwise("")), text,
    ]
    rows = docs.select("doc_id", F.concat_ws("\n", *lines).alias("text"))
    return audit(rows, "doc_id", "text", RULES, docs.select("doc_id", F.sha2(text, 256).alias("sha256")), docs.filter("doc_id % 50 = 1"))


def sql() -> dict[str, str]:
    from phaseloom.plans import states
    from phaseloom.plans.oracle import _AUROC, _FRAMES

    own = states.sql()
    changed = f"""WITH {_FRAMES}, la AS (SELECT video, frame, CAST(phase <> lag(phase) OVER (PARTITION BY video ORDER BY frame) AS BIGINT) AS label FROM f),
      hm AS ({own["hmm_value_filter"]}), sm AS ({own["semi_hmm_value_filter"]}), br AS (SELECT round(avg(label), 6) AS base_rate FROM la WHERE video % 2 = 0),
      ch AS (SELECT la.video, la.frame, label, hm.change_prob AS hmm, sm.change_prob AS semi_hmm, base_rate FROM la JOIN hm USING (video, frame) JOIN sm USING (video, frame), br WHERE la.video % 2 = 1 AND label IS NOT NULL)"""
    area = _AUROC.format(k="model,", part="model", w="1", t="ms", g="GROUP BY model")
    deltas = f"{changed}, vd AS (SELECT video, count(*) AS n, avg(label) AS observed, avg(pow(hmm - label, 2)) AS brier_a, avg(pow(semi_hmm - label, 2)) AS brier_b, avg(pow(semi_hmm - label, 2)) - avg(pow(hmm - label, 2)) AS delta FROM ch GROUP BY 1)"
    corpus = """al AS (SELECT doc_id, concat('- **document_id (own):** ', doc_id, chr(10), '- **source_sha256:** `', CASE WHEN doc_id % 9 = 0 THEN 'none' ELSE sha256(coalesce(text, '')) END, '`', chr(10), CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('- **language:** ', coalesce(lang, '')) END,
        chr(10), '## Reference 12 tM', chr(10), '> KG-', lpad(CAST(doc_id % 12 AS VARCHAR), 2, '0'), ' Table ', doc_id % 15, ', pp. ', doc_id % 60, '-', doc_id % 50, chr(10), '> tM ', doc_id % 130, CASE WHEN doc_id % 4 = 0 THEN ' - 91 hpi' ELSE '' END, chr(10), coalesce(text, '')) AS t FROM documents WHERE doc_id IS NOT NULL),
      ln AS (SELECT doc_id, unnest(string_split_regex(t, '\\r?\\n')) AS line FROM al),
      sq AS (SELECT doc_id, t, trim(regexp_replace(array_to_string([trim(regexp_replace(l, '^\\s*>+\\s?', ''), ' ') FOR l IN string_split_regex(t, '\\r?\\n')], ' '), '\\s+', ' ', 'g'), ' ') AS s FROM al),
      lt AS (SELECT regexp_replace(line, '[A-Z]{2}\\d*-[A-Z0-9-]+', '', 'g') AS own FROM ln WHERE ltrim(line, ' ') NOT LIKE '#%'),
      pg AS (SELECT CAST(unnest(list_concat(regexp_extract_all(t, '\\bpp?\\.[ \\t]*(\\d{1,3})', 1), regexp_extract_all(t, '\\bpp\\.[ \\t]*\\d{1,3}[–-](\\d{1,3})', 1))) AS INT) AS n FROM al),
      tb AS (SELECT CAST(unnest(regexp_extract_all(t, '\\bTable[ \\t]+(\\d{1,2})\\b', 1)) AS INT) AS n FROM al), fg AS (SELECT CAST(unnest(regexp_extract_all(t, '\\bFigure[ \\t]+(\\d{1,2})\\b', 1)) AS INT) AS n FROM al)"""
    meta = "regexp_extract(t, '(?m)^[ \\t]*-[ \\t]+\\*\\*{k}(?:[ \\t]*\\([^)\\n]*\\))?:\\*\\*[ \\t]*([^\\n]*)$', {g})"
    has = {k: meta.format(k=k, g=0) + " <> ''" for k in ("document_id", "language", "source_sha256")}
    lacking = {"sections_missing": ("## Reference", "the", "no such section"), "guards_missing": ("are medians, not ranges",)}
    holds = {name: "3 - " * (len(p) == 3) + "1 - " * (len(p) == 1) + "(" + " + ".join(f"coalesce(max(CAST(contains(s, '{x}') AS BIGINT)), 0)" for x in p) + ")" for name, p in lacking.items()}
    counted = {
        "short_texts": "count(*) FILTER (length(t) < 300) FROM al", **{f"no_{k}": f"count(*) FILTER (NOT ({c})) FROM al" for k, c in has.items()},
        "wrong_language": f"count(*) FILTER ({has['language']} AND trim({meta.format(k='language', g=1)}, ' ') <> 'en') FROM al", **{name: f"{c} FROM sq" for name, c in holds.items()},
        "pages_out_of_range": "count(*) FROM pg WHERE n NOT BETWEEN 1 AND 47", "tables_out_of_range": "count(*) FROM tb WHERE n NOT BETWEEN 1 AND 11", "figures_out_of_range": "count(*) FROM fg WHERE n <> 1",
        "definitions": "count(*) FROM sq WHERE regexp_matches(s, '(?i)\\bthe\\s+the\\b|is defined as')", "overclaims": "count(*) FROM sq WHERE regexp_matches(s, '(?i)\\bproves\\b')",
        "times_without_unit": "count(*) FROM lt WHERE regexp_matches(own, 'tM|tEB') AND regexp_matches(own, '\\b\\d{2,3}\\b') AND NOT regexp_matches(own, 'hpi|%')",
        "medians_as_ranges": "count(*) FROM al WHERE regexp_matches(t, '\\b(23[ \\t]*[–-][ \\t]*24|89[ \\t]*[–-][ \\t]*91)[ \\t]*hpi')",
        "gaps_missing": "greatest(12 - count(DISTINCT x), 0) FROM (SELECT unnest(regexp_extract_all(t, '\\bKG-\\d{2}\\b')) AS x FROM al)", "limits_missing": "greatest(2 - count(DISTINCT x), 0) FROM (SELECT unnest(regexp_extract_all(t, '\\bLIM-\\d{2}\\b')) AS x FROM al)",
        "hash_differs": f"count(*) FROM al JOIN documents d USING (doc_id) WHERE trim(replace({meta.format(k='source_sha256', g=1)}, '`', ''), ' ') <> sha256(coalesce(d.text, ''))", "listed_elsewhere": "count(*) FROM al WHERE doc_id % 50 = 1",
    }
    return {
        "corpus_audit": f"WITH {corpus}, k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {q.replace(' FROM ', ' AS n FROM ', 1)}" for c, q in counted.items()) + ') SELECT c AS "check", CAST(n AS BIGINT) AS n_bad, CAST(n = 0 AS BIGINT) AS passed FROM k',
        "state_ladder": f"""{changed}, ms AS (SELECT 'base_rate' AS model, base_rate AS prob, label FROM ch UNION ALL SELECT 'hmm', hmm, label FROM ch UNION ALL SELECT 'semi_hmm', semi_hmm, label FROM ch)
          SELECT model, round(auroc, 6) AS auroc, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, n FROM {area} JOIN
            (SELECT model, avg(pow(prob - label, 2)) AS brier, avg(CAST((prob >= 0.5) = (label = 1) AS DOUBLE)) AS accuracy, count(*) AS n FROM ms GROUP BY 1) USING (model)""",
        "video_deltas": f"{deltas} SELECT video, n, round(observed, 6) AS observed, round(brier_a, 6) AS brier_a, round(brier_b, 6) AS brier_b, round(delta, 6) AS delta FROM vd",
        "paired_tests": f"""{deltas}, rk AS (SELECT delta, avg(r) OVER (PARTITION BY m) AS r FROM (SELECT delta, m, row_number() OVER (ORDER BY m) AS r FROM (SELECT delta, round(abs(delta), 12) AS m FROM vd WHERE delta <> 0))),
          sg AS (SELECT count(*) FILTER (delta < 0) AS b, count(*) FILTER (delta > 0) AS w FROM vd),
          sp AS (SELECT least(1.0, 2 * sum(exp(lgamma(b + w + 1) - lgamma(i + 1) - lgamma(b + w - i + 1) - (b + w) * ln(2.0)))) AS p FROM sg, range(100000) t(i) WHERE i <= least(b, w))
          SELECT count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, round(median(delta), 6) AS median, count(*) FILTER (delta < 0) AS n_better, count(*) FILTER (delta > 0) AS n_worse, count(*) FILTER (delta = 0) AS n_tied,
            round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) AS t, round((SELECT coalesce(sum(r) FILTER (delta > 0), 0) FROM rk), 6) AS w_plus, round((SELECT coalesce(sum(r) FILTER (delta < 0), 0) FROM rk), 6) AS w_minus,
            round((SELECT p FROM sp), 6) AS sign_p FROM vd""",
    }
