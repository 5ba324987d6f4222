"""Registered queries of scores over classes, filtered search, projections, spans of sentences and functions called from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.functions import registered
from phaseloom.operators import grounding, metrics, vectors
from phaseloom.plans.catalog import class_scores, frames, predictions, query, rounded
from phaseloom.session import table


@query
def class_areas(spark, sf):
    return rounded(metrics.class_areas(class_scores(spark, sf), 3))


@query
def multiclass_scores(spark, sf):
    return rounded(metrics.multiclass_scores(class_scores(spark, sf), 3))


@query
def filtered_topk(spark, sf):
    """Five nearest of each query among rows of its own label; queries whose id is divisible by 60 take rows of any label."""
    rows = table(spark, sf, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").withColumn("wanted", F.when(F.col("vec_id") % 60 != 0, F.col("label")))
    return rounded(vectors.cosine_topk(asked, rows, 5, match={"label": "wanted"}))


@query
def projection_errors(spark, sf):
    """Rows only, held against numpy in tests: vectors rebuilt from 1 to all of their principal axes."""
    rows = table(spark, sf, "embeddings")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    mean, axes = vectors.principal_axes(rows, "embedding", dims)
    out = None
    for k in sorted({1, 2, 8, dims // 2, dims}):
        one = vectors.reconstruction(rows, "embedding", mean, axes[:k]).select(F.lit(k).cast("long").alias("components"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query
def projected_forecast(spark, sf):
    """Rows only: linear dynamics of eight principal coordinates, the axes first and then the dynamics fitted by sums."""
    rows = table(spark, sf, "embeddings")
    flat = vectors.projected(rows, "embedding", *vectors.principal_axes(rows, "embedding", 8))
    a, b = vectors.linear_dynamics(flat, "label", "vec_id", "projection")
    return rounded(vectors.forecast_errors(flat, "label", "vec_id", "projection", a, b, [1, 2, 3]))


@query
def sentence_spans(spark, sf):
    return grounding.sentence_spans(table(spark, sf, "documents").filter("doc_id is not null"), "text", "doc_id").select("doc_id", "sentence_no", F.md5(F.col("sentence").cast("binary")).alias("digest"), "start", "end")


@query
def sql_segments(spark, sf):
    """Segments by the table function, in SQL."""
    registered.register(spark)
    return spark.sql("SELECT * FROM segments(TABLE({rows}), 'video', 'frame', 'phase')", rows=frames(spark, sf).select("video", "frame", "phase"))


@query
def sql_ranking_areas(spark, sf):
    """Areas of each video by the table function, over counts of scores."""
    registered.register(spark)
    text = "SELECT * FROM ranking_areas(TABLE(SELECT video, prob, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM {preds} GROUP BY video, prob), 'video')"
    return rounded(spark.sql(text, preds=predictions(spark, sf)))


@query
def sql_calibration(spark, sf):
    """Calibration error and log loss of each phase, by functions called from SQL."""
    registered.register(spark)
    text = """WITH b AS (SELECT phase, probability_bin(prob) AS bin, count(*) AS n, avg(prob) AS said, avg(CAST(label AS DOUBLE)) AS seen FROM {preds} GROUP BY ALL)
      SELECT phase, calibration_error(n, said, seen) AS ece FROM b GROUP BY phase"""
    loss = "SELECT phase, count(*) AS n, avg(clipped_log_loss(prob, label)) AS log_loss FROM {preds} GROUP BY phase"
    preds = predictions(spark, sf)
    return rounded(spark.sql(text, preds=preds).join(spark.sql(loss, preds=preds), "phase"))


def sql() -> dict[str, str]:
    from phaseloom.plans.oracle import _AUROC, _CLASSES, _PREDS, _SEGMENTS

    def precision(key: str, rows: str) -> str:
        return f"""(SELECT {key}, sum(pos * hits / seen) / nullif(sum(pos), 0) AS ap FROM (SELECT *, sum(pos) OVER o AS hits, sum(pos + neg) OVER o AS seen FROM (
          SELECT {key}, prob, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos, count(*) FILTER (label = 0) AS neg FROM {rows} GROUP BY ALL) WINDOW o AS (PARTITION BY {key} ORDER BY prob DESC)) GROUP BY 1)"""

    def area(key: str, rows: str) -> str:
        return _AUROC.format(k=f"{key},", part=key, w="1", t=rows, g=f"GROUP BY {key}")

    areas = f"""{_CLASSES}, ar AS (SELECT class, support, auroc, CASE WHEN auroc IS NOT NULL THEN ap END AS ap FROM (SELECT class, CAST(sum(label) AS BIGINT) AS support FROM each GROUP BY 1)
      JOIN {area("class", "each")} USING (class) JOIN {precision("class", "each")} USING (class))"""
    bins = "CAST(CASE " + " ".join(f"WHEN prob >= {k} * 0.1::DOUBLE THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END AS BIGINT)"
    return {
        "class_areas": f"WITH {areas} SELECT class, support, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM ar",
        "multiclass_scores": f"""WITH {areas}, m AS (SELECT avg(auroc) AS a, sum(auroc * support) / sum(support) AS b, avg(ap) AS c, sum(ap * support) / sum(support) AS d FROM ar WHERE auroc IS NOT NULL),
          q AS (SELECT truth, probs, list_transform(probs, lambda p: greatest(least(p, 1.0::DOUBLE), 1e-12)) AS kept, list_max(probs) AS prob, CAST(list_position(probs, list_max(probs)) - 1 = truth AS DOUBLE) AS hit FROM cs),
          e AS (SELECT sum(n * gap) / sum(n) AS ece FROM (SELECT {bins} AS bin, count(*) AS n, abs(avg(prob) - avg(hit)) AS gap FROM q GROUP BY 1))
          SELECT round(any_value(m.a), 6) AS macro_auroc, round(any_value(m.b), 6) AS weighted_auroc, round(any_value(m.c), 6) AS macro_ap, round(any_value(m.d), 6) AS weighted_ap,
            round(avg(list_sum([power(probs[k + 1] - CAST(truth = k AS DOUBLE), 2) FOR k IN [0, 1, 2]])), 6) AS brier, round(avg(-ln(kept[truth + 1] / list_sum(kept))), 6) AS log_loss, round(avg(hit), 6) AS accuracy, count(*) AS n,
            round(any_value(e.ece), 6) AS ece FROM q, m, e""",
        "filtered_topk": """WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS s FROM n),
          c AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v) / (q.s * r.s) AS score FROM u q JOIN u r ON q.vec_id <> r.vec_id AND (q.vec_id % 60 = 0 OR q.label = r.label) WHERE q.vec_id % 20 = 0 AND q.s > 0 AND r.s > 0),
          rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM rk WHERE rank <= 5""",
        "sentence_spans": """WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])([\\t\\n\\x0B\\f\\r ]+)|(\\n+)', concat('\\1', chr(1), '\\2\\3', chr(1)), 'g'), chr(1)) AS parts FROM documents WHERE doc_id IS NOT NULL),
          x AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS place FROM s),
          y AS (SELECT *, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM x)
          SELECT doc_id, place // 2 AS sentence_no, md5(trim(part, ' ')) AS digest, start, start + length(part) AS "end" FROM y WHERE place % 2 = 0 AND trim(part, ' ') <> ''""",
        "sql_segments": f'WITH {_SEGMENTS} SELECT video, seg_no, phase, start, "end", duration FROM s',
        "sql_ranking_areas": f"""WITH {_PREDS} SELECT video, n_pos, n_neg, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM (SELECT video, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM p GROUP BY 1)
          JOIN {area("video", "p")} USING (video) JOIN {precision("video", "p")} USING (video)""",
        "sql_calibration": f"""WITH {_PREDS}, b AS (SELECT phase, {bins} AS bin, count(*) AS n, abs(avg(prob) - avg(label)) AS gap, sum(-ln(greatest(least(CASE WHEN label = 1 THEN prob ELSE 1 - prob END, 1 - 1e-7), 1e-7))) AS loss FROM p GROUP BY 1, 2)
          SELECT phase, round(sum(n * gap) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n, round(sum(loss) / sum(n), 6) AS log_loss FROM b GROUP BY 1""",
    }
