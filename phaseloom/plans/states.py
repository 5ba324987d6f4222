"""Registered queries of the state models, with the SQL that filters frame by frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from phaseloom.operators import hmm, scan, semimarkov, trajectory
from phaseloom.plans.catalog import frames, observed, query, rounded

def bucket():
    """A frame's bucket: its value in steps of 20."""
    return F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("value") / 20)))


def by_value(spark, sf):
    """Frames of even videos, and of odd ones without phase but with emissions by how often phases show a value's bucket."""
    rows = frames(spark, sf)
    train = rows.filter("video % 2 = 0")
    return train, semimarkov.bucket_emissions(train, rows.filter("video % 2 = 1").drop("phase"), bucket())


@query
def hmm_value_filter(spark, sf):
    """Filtering, smoothing and changes from values alone, in blocks of 32 frames: every video goes through transfer matrices."""
    train, asked = by_value(spark, sf)
    log_pi, log_a = hmm.parameters(train)
    found = scan.decode(asked, log_pi, log_a, k=3, rate=0.2, size=32)
    return rounded(found.select("video", "frame", "state", F.array_max("filtered").alias("p"), "log_norm", "smoothed_state", "next_state", "change_prob"))


@query
def hmm_value_likelihood(spark, sf):
    train, asked = by_value(spark, sf)
    log_pi, log_a = hmm.parameters(train)
    return rounded(scan.log_likelihoods(scan.decode(asked, log_pi, log_a, smooth=False)))


@query
def semi_hmm_value_filter(spark, sf):
    """The explicit-duration model from values alone, with shares of durations: filtering, the next frame's phase, changes over 1 and 3 frames."""
    train, asked = by_value(spark, sf)
    found = semimarkov.decode(asked, semimarkov.fit(train, family="empirical"), k=3, rate=0.2)
    return rounded(found.select("video", "frame", "state", F.array_max("filtered").alias("p"), "next_state", F.array_max("next_phase").alias("next_p"), "leave", "age", "change_prob", "change_k"))


@query
def segment_chain(spark, sf):
    """Each segment's duration under the empirical durations, and where it may lead."""
    runs = trajectory.segments(frames(spark, sf))
    found = semimarkov.chain(runs, hmm.empirical_durations(runs, 24), hmm.segment_probabilities(runs))
    best = F.element_at(F.array_sort(F.transform(F.map_entries("next_phases"), lambda e: F.struct((-F.round(e["value"], 9)).alias("p"), e["key"].alias("b")))), 1)
    some = F.size("next_phases") > 0
    return rounded(found.select("video", "seg_no", "phase", "duration", "duration_p", F.size("next_phases").alias("n_next"), F.when(some, best["b"]).alias("next_phase"), F.when(some, -best["p"]).alias("next_p")))


@query
def semi_hmm_filter(spark, sf):
    """Rows only: emissions come from a fitted classifier; the recursion is held against SQL in `semi_hmm_value_filter` and against enumeration in tests. Parameters come from the other videos."""
    train, asked = observed(spark, sf)
    return rounded(semimarkov.decode(asked, semimarkov.fit(train), 3, 0.2).drop("filtered", "next_phase"))


@query
def hmm_decode(spark, sf):
    """Rows only, as `semi_hmm_filter`: filtering, smoothing and changes, in blocks."""
    train, asked = observed(spark, sf)
    log_pi, log_a = hmm.parameters(train)
    return rounded(scan.decode(asked, log_pi, log_a, 3, 0.2).drop("filtered"))


@query
def hmm_best_path(spark, sf):
    """Rows only, as `semi_hmm_filter`: the likeliest path of each video, in blocks of 64 frames."""
    train, asked = observed(spark, sf)
    return scan.best_paths(asked, *hmm.parameters(train), size=64)


@query
def phase_decoding_accuracy(spark, sf):
    """Rows only, as it rests on the filtered states: how often each model and the classifier alone name the phase of videos that were not learnt from. The classifier sees values and frame numbers."""
    train, asked = observed(spark, sf)
    log_pi, log_a = hmm.parameters(train)
    found = scan.decode(asked, log_pi, log_a, 3, 0.2, smooth=False).select("video", "frame", "state", "entropy")
    found = found.join(scan.best_paths(asked, log_pi, log_a), ["video", "frame"])
    found = found.join(semimarkov.decode(asked, semimarkov.fit(train), 3, 0.2).select("video", "frame", F.col("state").alias("semi_state")), ["video", "frame"])
    found = found.join(asked.select("video", "frame", (F.array_position("emission", F.array_max("emission")) - 1).alias("by_emission")), ["video", "frame"])
    found = found.join(frames(spark, sf).select("video", "frame", "phase"), ["video", "frame"])
    hits = {"hmm": "state", "semi_hmm": "semi_state", "viterbi": "viterbi_state", "emission": "by_emission"}
    return rounded(found.groupBy("video").agg(*[F.avg((F.col(c) == F.col("phase")).cast("double")).alias(name) for name, c in hits.items()], F.avg("entropy").alias("entropy")))


def sql() -> dict[str, str]:
    from phaseloom.plans.oracle import _GRID, _SEGMENTS

    train = _SEGMENTS.replace("AS phase FROM ev)", "AS phase FROM ev WHERE video % 2 = 0)")
    steps = """wc AS (SELECT a, b, count(*) AS n FROM (SELECT phase AS a, lead(phase) OVER (PARTITION BY video ORDER BY seg_no) AS b FROM s) WHERE {cond} GROUP BY 1, 2),
      fw AS (SELECT g.a, g.b, coalesce(wc.n, 0) + 2.0::DOUBLE * pow(0.5, g.b - g.a - 1) / sum(pow(0.5, g.b - g.a - 1)) OVER (PARTITION BY g.a) AS mass FROM grid g LEFT JOIN wc ON wc.a = g.a AND wc.b = g.b WHERE g.b > g.a),
      fm AS (SELECT a, b, mass / sum(mass) OVER (PARTITION BY a) AS m FROM fw)"""
    seen = """bucketed AS (SELECT phase, least(9, greatest(0, CAST(floor(value / 20) AS INTEGER))) AS bucket, count(*) AS k FROM f GROUP BY 1, 2),
      em AS (SELECT a.range AS phase, b.range AS bucket, (coalesce(k, 0) + 1.0::DOUBLE) / (sum(coalesce(k, 0)) OVER (PARTITION BY a.range) + 10) AS p
             FROM range(15) a CROSS JOIN range(10) b LEFT JOIN bucketed k ON k.phase = a.range AND k.bucket = b.range),
      ev2 AS (SELECT bucket, list(p ORDER BY phase) AS e FROM em GROUP BY 1),
      asked AS (SELECT video, frame, e FROM ev JOIN ev2 ON bucket = least(9, greatest(0, CAST(floor(value / 20) AS INTEGER))) WHERE video % 2 = 1),
      i AS (SELECT phase, count(*) AS k FROM f WHERE frame = 1 GROUP BY 1),
      pi AS (SELECT list(coalesce(k, 0) / (SELECT sum(k) FROM i) ORDER BY r.range) AS pi FROM range(15) r LEFT JOIN i ON i.phase = r.range)"""
    hmm_tables = f"""{train}, {_GRID}, {steps.format(cond="b >= a")},
      st AS (SELECT a, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same, count(*) AS tot FROM (SELECT phase AS a, lead(phase) OVER (PARTITION BY video ORDER BY frame) AS b FROM f) WHERE b >= a GROUP BY 1),
      kp AS (SELECT g.a, g.b, fm.m, CASE WHEN st.tot > 0 AND g.a < 14 THEN st.same / st.tot ELSE 1.0 END AS keep FROM grid g LEFT JOIN fm ON fm.a = g.a AND fm.b = g.b LEFT JOIN st ON st.a = g.a),
      tr AS (SELECT a, b, CAST(CASE WHEN a = b THEN keep WHEN b > a THEN (1 - keep) * coalesce(m, 0) ELSE 0.0 END AS DOUBLE) AS p FROM kp),
      co AS (SELECT list(c ORDER BY b) AS cols FROM (SELECT b, list(p ORDER BY a) AS c FROM tr GROUP BY b)),
      ro AS (SELECT list(r ORDER BY a) AS r FROM (SELECT a, list(p ORDER BY b) AS r FROM tr GROUP BY a)), {seen},
      fwd AS (
        SELECT video, frame, [v / list_sum(u) FOR v IN u] AS x, ln(list_sum(u)) AS log_norm, 0.2::DOUBLE AS change_prob FROM (SELECT video, frame, [pi[j] * e[j] FOR j IN range(1, 16)] AS u FROM asked, pi WHERE frame = 1)
        UNION ALL
        SELECT video, frame, [v / list_sum(u) FOR v IN u], ln(list_sum(u)), 1 - list_sum(same) / list_sum(u)
        FROM (SELECT n.video, n.frame, [list_dot_product(x, cols[j]) * n.e[j] FOR j IN range(1, 16)] AS u, [x[j] * cols[j][j] * n.e[j] FOR j IN range(1, 16)] AS same FROM fwd JOIN asked n ON n.video = fwd.video AND n.frame = fwd.frame + 1, co))"""
    backward = """bwd AS (
        SELECT video, max(frame) AS frame, [1.0::DOUBLE FOR j IN range(15)] AS y FROM asked GROUP BY video
        UNION ALL
        SELECT video, frame, [v / list_sum(u) FOR v IN u] FROM (SELECT n.video, n.frame - 1 AS frame, [list_dot_product(r[j], [n.e[k] * y[k] FOR k IN range(1, 16)]) FOR j IN range(1, 16)] AS u FROM bwd JOIN asked n ON n.video = bwd.video AND n.frame = bwd.frame, ro WHERE n.frame > 1))"""
    semi_tables = f"""{train}, {_GRID}, {steps.format(cond="b > a")}, {seen},
      le AS (SELECT list(c ORDER BY b) AS lead FROM (SELECT g.b, list(coalesce(m, 0.0::DOUBLE) ORDER BY g.a) AS c FROM grid g LEFT JOIN fm ON fm.a = g.a AND fm.b = g.b GROUP BY g.b)),
      dm AS (SELECT CAST(max(duration) AS BIGINT) AS dm FROM s),
      dk AS (SELECT phase, duration AS d, count(*) AS k FROM s WHERE censoring = 'OBSERVED' GROUP BY 1, 2),
      dp AS (SELECT a.range AS phase, b.range AS d, CASE WHEN sum(coalesce(k, 0)) OVER w > 0 THEN (coalesce(k, 0) + 0.001::DOUBLE) / (sum(coalesce(k, 0)) OVER w + dm * 0.001::DOUBLE) ELSE 1.0::DOUBLE / dm END AS p, dm
             FROM range(15) a CROSS JOIN dm CROSS JOIN range(1, 10000) b LEFT JOIN dk ON dk.phase = a.range AND dk.d = b.range WHERE b.range <= dm WINDOW w AS (PARTITION BY a.range)),
      hz AS (SELECT phase, d, p / sum(p) OVER (PARTITION BY phase ORDER BY d DESC) AS h FROM dp),
      ha AS (SELECT list(c ORDER BY phase) AS h FROM (SELECT phase, list(h ORDER BY d) AS c FROM hz GROUP BY phase)),
      run AS (
        SELECT video, frame, [[v / t FOR v IN r] FOR r IN u] AS x
        FROM (SELECT video, frame, u, list_sum([list_sum(r) FOR r IN u]) AS t FROM (SELECT video, frame, [list_concat([pi[j] * e[j]], [0.0::DOUBLE FOR d IN range(1, dm)]) FOR j IN range(1, 16)] AS u FROM asked, pi, dm WHERE frame = 1))
        UNION ALL
        SELECT video, frame, CASE WHEN t > 0 THEN [[v / t FOR v IN r] FOR r IN u] ELSE [[CASE WHEN j = 15 AND d = dm THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR d IN range(1, dm + 1)] FOR j IN range(1, 16)] END
        FROM (SELECT video, frame, u, dm, list_sum([list_sum(r) FOR r IN u]) AS t
          FROM (SELECT video, frame, dm, [list_concat([list_dot_product(gone, lead[j]) * e[j]], [x[j][d] * (1 - h[j][d]) * e[j] FOR d IN range(1, dm)]) FOR j IN range(1, 16)] AS u
            FROM (SELECT n.video, n.frame, x, n.e, h, lead, dm, [list_dot_product(x[j], h[j]) FOR j IN range(1, 16)] AS gone FROM run JOIN asked n ON n.video = run.video AND n.frame = run.frame + 1, ha, le, dm)))),
      o1 AS (SELECT video, frame, x, h, dm, lead, [list_sum(r) FOR r IN x] AS p, [list_dot_product(x[j], h[j]) FOR j IN range(1, 16)] AS gone FROM run, ha, le, dm),
      o2 AS (SELECT *, CASE WHEN list_sum(n0) > 0 THEN n0 ELSE [CASE WHEN j = 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR j IN range(1, 16)] END AS nx
        FROM (SELECT *, [list_dot_product(gone, lead[j]) + list_sum([x[j][d] * (1 - h[j][d]) FOR d IN range(1, dm + 1)]) FOR j IN range(1, 16)] AS n0 FROM o1))"""
    durations = """k AS (SELECT phase, least(duration, 24) AS d, count(*) AS k FROM s WHERE censoring = 'OBSERVED' GROUP BY 1, 2),
      gr AS (SELECT a.range AS phase, b.range + 1 AS d, coalesce(k.k, 0) AS k FROM range(15) a CROSS JOIN range(24) b LEFT JOIN k ON k.phase = a.range AND k.d = b.range + 1),
      pm AS (SELECT phase, d, CASE WHEN sum(k) OVER w > 0 THEN (k + 0.001::DOUBLE) / (sum(k) OVER w + 0.024::DOUBLE) ELSE 1.0::DOUBLE / 24 END AS p FROM gr WINDOW w AS (PARTITION BY phase))"""
    return {
        "hmm_value_filter": f"""WITH RECURSIVE {hmm_tables}, {backward}
          SELECT f.video, f.frame, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS state, round(list_max(x), 6) AS p, round(log_norm, 6) AS log_norm, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS smoothed_state,
            CAST(list_position(nx, list_max(nx)) - 1 AS BIGINT) AS next_state, round(change_prob, 6) AS change_prob
          FROM (SELECT fwd.*, [x[j] * y[j] FOR j IN range(1, 16)] AS s, [list_dot_product(x, cols[j]) FOR j IN range(1, 16)] AS nx FROM fwd JOIN bwd ON bwd.video = fwd.video AND bwd.frame = fwd.frame, co) f""",
        "hmm_value_likelihood": f"WITH RECURSIVE {hmm_tables} SELECT video, count(*) AS n, round(sum(log_norm), 6) AS log_likelihood, round(avg(log_norm), 6) AS per_frame FROM fwd GROUP BY video",
        "semi_hmm_value_filter": f"""WITH RECURSIVE {semi_tables}
          SELECT video, frame, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS state, round(list_max(p), 6) AS p, CAST(list_position(nx, list_max(nx)) - 1 AS BIGINT) AS next_state, round(list_max(nx) / list_sum(nx), 6) AS next_p,
            round(list_sum(gone), 6) AS leave, round(list_sum([list_sum([r[d] * d FOR d IN range(1, dm + 1)]) FOR r IN x]), 6) AS age,
            CASE WHEN frame = 1 THEN 0.2 ELSE round(list_sum([r[1] FOR r IN x]), 6) END::DOUBLE AS change_prob, CASE WHEN frame <= 3 THEN 0.2 ELSE round(list_sum([list_sum(r[1:3]) FOR r IN x]), 6) END::DOUBLE AS change_k FROM o2""",
        "segment_chain": f"""WITH {_SEGMENTS}, {_GRID}, {steps.format(cond="b > a")}, {durations},
          nx AS (SELECT a AS phase, count(*) AS n_next, arg_min(b, (-round(m, 9), b)) AS next_phase, max(round(m, 9)) AS next_p FROM fm WHERE m > 0 GROUP BY a)
          SELECT video, seg_no, s.phase, duration, round(pm.p, 6) AS duration_p, coalesce(n_next, 0) AS n_next, next_phase, round(next_p, 6) AS next_p FROM s LEFT JOIN pm ON pm.phase = s.phase AND pm.d = least(duration, 24) LEFT JOIN nx ON nx.phase = s.phase""",
    }
