"""SQL of the registered queries, for an engine that reads the same tables."""

from __future__ import annotations

from phaseloom.plans.catalog import KEEP_RULES, LINE_RULES, SAID

_FRAMES = """
ev AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value, event_id FROM events),
f AS (SELECT video, frame, value, event_id, least(14, (frame-1)//12 + CASE WHEN ((frame-1)//12)%3 = 2 THEN 1 ELSE 0 END + CASE WHEN value > 150 THEN 1 ELSE 0 END) AS phase FROM ev)
"""
_WINDOWS = (
    _FRAMES
    + """,
w0 AS (SELECT video, frame AS first_frame, count(*) OVER w AS n, max(phase) OVER w - min(phase) OVER w AS spread,
         first_value(phase) OVER w AS first_frame_phase, last_value(phase) OVER w AS last_frame_phase
       FROM f WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
w AS (SELECT video, first_frame, first_frame_phase, last_frame_phase, CAST(first_frame_phase <> last_frame_phase AS BIGINT) AS consistency_flag FROM w0 WHERE n = 8 AND spread <= 1)
"""
)
_SEGMENTS = (
    _FRAMES
    + """,
c AS (SELECT *, CASE WHEN phase <> lag(phase) OVER (PARTITION BY video ORDER BY frame) THEN 1 ELSE 0 END AS change FROM f),
g AS (SELECT *, sum(change) OVER (PARTITION BY video ORDER BY frame) AS seg_no FROM c),
s0 AS (SELECT video, CAST(seg_no AS BIGINT) AS seg_no, min(phase) AS phase, min(frame) AS start, max(frame) AS "end", count(*) AS duration FROM g GROUP BY 1, 2),
s1 AS (SELECT *, count(*) OVER (PARTITION BY video) AS n_segments FROM s0),
s AS (SELECT *, CASE WHEN n_segments = 1 THEN 'BOTH' WHEN seg_no = 0 THEN 'LEFT' WHEN seg_no = n_segments - 1 THEN 'RIGHT' ELSE 'OBSERVED' END AS censoring FROM s1)
"""
)
_EVENTS = (
    _SEGMENTS
    + """,
e0 AS (SELECT video, seg_no, phase AS from_phase, lead(phase) OVER o AS to_phase, "end" AS window_start, lead(start) OVER o AS window_end FROM s WINDOW o AS (PARTITION BY video ORDER BY seg_no)),
e AS (SELECT *, to_phase - from_phase AS distance, CAST(abs(to_phase - from_phase) > 1 AS BIGINT) AS is_skip FROM e0 WHERE to_phase IS NOT NULL)
"""
)
_CENTRES = ", ctr AS (SELECT video, CAST(floor((max(frame) + 1) / 2) AS BIGINT) AS centre FROM f GROUP BY video)"
_SCORES = _FRAMES + ", sc AS (SELECT video, frame, round(value, 6) AS first, round(100.0 - frame, 6) AS second FROM f)"
_GRID = "grid AS (SELECT a.range AS a, b.range AS b FROM range(15) a, range(15) b)"
_PREDS = """p AS (SELECT d.doc_id, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS prob, CAST(l.quality AS BIGINT) AS label, d.doc_id % 15 AS phase, d.doc_id % 20 AS video
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_EDGES = """edges AS (SELECT CAST(range AS BIGINT) AS bin, range * 0.1::DOUBLE AS low, (range + 1) * 0.1::DOUBLE AS high FROM range(10)),
b AS (SELECT e.bin, e.low, e.high, count(p.prob) AS n, avg(p.prob) AS mean_predicted, avg(CAST(p.label AS DOUBLE)) AS mean_observed
      FROM edges e LEFT JOIN p ON p.prob >= e.low AND (p.prob < e.high OR e.bin = 9) GROUP BY 1, 2, 3)"""
_CENTROID = """x AS (SELECT vec_id, CAST(label AS BIGINT) AS actual, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
m AS (SELECT actual AS c, dim, avg(v) AS m FROM x GROUP BY 1, 2),
dist AS (SELECT vec_id, actual, c, round(sqrt(sum((v - m) * (v - m))), 12) AS d FROM x JOIN m USING (dim) GROUP BY 1, 2, 3),
pr AS (SELECT vec_id, actual, arg_min(c, (d, c)) AS predicted FROM dist GROUP BY 1, 2)"""
_CLASS = (
    _CENTROID
    + """,
cl AS (SELECT k AS class, count(*) FILTER (actual = k) AS support, count(*) FILTER (predicted = k) AS said, count(*) FILTER (actual = k AND predicted = k) AS hits
       FROM pr, (SELECT DISTINCT actual AS k FROM pr) GROUP BY 1),
cm AS (SELECT class, support, CASE WHEN said > 0 THEN hits / said ELSE 0.0 END AS "precision", CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall, CASE WHEN said + support > 0 THEN 2.0 * hits / (said + support) ELSE 0.0 END AS f1 FROM cl)"""
)
_RATE = """sum(CASE WHEN prob >= 0.5 AND label = 1 THEN {w} ELSE 0 END) AS tp, sum(CASE WHEN prob >= 0.5 AND label = 0 THEN {w} ELSE 0 END) AS fp,
  sum(CASE WHEN prob < 0.5 AND label = 1 THEN {w} ELSE 0 END) AS fn, sum(CASE WHEN prob < 0.5 AND label = 0 THEN {w} ELSE 0 END) AS tn"""
_RATES = """CAST(tp + fp + fn + tn AS BIGINT) AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision",
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_rate, round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_rate"""
_AUROC = """(SELECT {k} sum(pos * (under + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM (
    SELECT {k} prob, sum(CASE WHEN label = 1 THEN {w} ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN {w} ELSE 0 END) AS neg FROM {t} GROUP BY {k} prob)) {g})"""
_BOOT = """vid AS (SELECT video, row_number() OVER (ORDER BY video) - 1 AS place, count(*) OVER () AS nv FROM (SELECT DISTINCT video FROM p)),
draws AS (SELECT r.range AS resample_id, d.range AS draw FROM range({n}) r, range((SELECT max(nv) FROM vid)) d),
mult AS (SELECT resample_id, video, count(*) AS k FROM (SELECT resample_id, CAST('0x' || substr(md5('boot:' || resample_id || ':' || draw), 1, 12) AS BIGINT) % (SELECT max(nv) FROM vid) AS place FROM draws) JOIN vid USING (place) GROUP BY 1, 2),
bp AS (SELECT resample_id, prob, label, k FROM p JOIN mult USING (video))"""
_CLASSES = """r AS (SELECT n_chars % 3 AS truth, [CAST((n_chars * (k + 3) + doc_id) % 97 + 1 AS DOUBLE) for k in [0, 1, 2]] AS raw FROM documents WHERE n_chars IS NOT NULL AND doc_id IS NOT NULL),
cs AS (SELECT truth, [x / (raw[1] + raw[2] + raw[3]) for x in raw] AS probs FROM r),
each AS (SELECT CAST(k AS BIGINT) AS class, probs[k + 1] AS prob, CAST(truth = k AS BIGINT) AS label FROM cs, range(3) t(k))"""
_TIMES = (
    _FRAMES
    + """, ft AS (SELECT f.*, CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) AS time FROM f JOIN events USING (event_id)),
sm AS (SELECT *, CAST(time = lag(time) OVER (PARTITION BY video ORDER BY frame) AS BIGINT) AS same FROM ft),
wt AS (SELECT video, frame AS first_frame, count(*) OVER w AS n, count(time) OVER w AS known, first_value(time) OVER w AS a, last_value(time) OVER w AS b, CAST(coalesce(sum(same) OVER s, 0) AS BIGINT) AS n_zero_steps,
    first_value(phase) OVER w AS first_frame_phase, last_value(phase) OVER w AS last_frame_phase
    FROM sm WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), s AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))"""
)
_FOLD = "translate(lower(coalesce(text, '')), 'éèêëàâîïôûùç–—’‘ʼ′', 'eeeeaaiiouuc--''''''''')"


def _phrases(phrases: tuple[str, ...], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


def _count(phrases: tuple[str, ...], text: str = "t") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '" + p.replace("'", "''") + "') AS BIGINT)" for p in phrases) + ")"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _build() -> dict[str, str]:
    from phaseloom.functions import vocabulary as V

    terms = f"list_filter(list_distinct(regexp_extract_all({_FOLD}, '[a-z0-9+]{{3,}}')), lambda x: NOT list_contains({_list(V.STOP_WORDS)}, x))"
    lexical = f"""q AS (SELECT item_id AS query_id, {terms} AS t FROM benchmark), bl AS (SELECT doc_id AS block_id, {terms} AS t FROM documents),
      qt AS (SELECT query_id, len(t) AS nq, unnest(t) AS term FROM q), bt AS (SELECT block_id, len(t) AS nb, unnest(t) AS term FROM bl),
      sc AS (SELECT query_id, block_id, round(count(*) / (sqrt(nq) + sqrt(nb)), 4) AS score FROM qt JOIN bt USING (term) GROUP BY query_id, block_id, nq, nb),
      rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS rank FROM sc)"""
    cosine = """n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
      cs AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM n a, n b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
      rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs)"""
    category = f"""CASE WHEN {_phrases(V.HYBRID_PATTERNS)} OR ({_phrases(V.DYNAMIC_KEYWORDS)} AND {_phrases(V.DOCUMENTARY_KEYWORDS)}) THEN 'HYBRID' WHEN {_phrases(V.DYNAMIC_KEYWORDS)} THEN 'DYNAMIC_DATA'
      WHEN {_phrases(V.DOCUMENTARY_KEYWORDS)} OR {_phrases(V.DOMAIN_TERMS)} THEN 'DOCUMENTARY' ELSE 'UNKNOWN' END"""
    framings = " UNION ALL ".join(f"SELECT '{name}' AS framing FROM t WHERE {_phrases(words)}" for name, words in V.FRAMINGS.items())
    plain = r"(?i)\bt(?:9\+(\W|$)|(?:pb2|pna|pnf|sb|eb|m|b|[2-9])\b)"  # without lookahead: what follows t9+ is put back
    said = f"regexp_extract_all(regexp_replace(coalesce({{}}, ''), '{plain}', ' \\1', 'g'), '[-−]?[0-9]+([.,][0-9]+)?%?', 0)"

    def escaped(p: str) -> str:
        return ("\\b" if p[0].isalnum() else "") + "".join(c if c.isalnum() or c == " " else "\\" + c for c in p).replace("'", "''")

    quoted = " ".join(f"WHEN {i} THEN '" + x.replace("'", "''") + "'" for i, x in enumerate(SAID))
    said_here = f"conversations AS (SELECT conv_id, turn, role, concat(coalesce(text, ''), chr(10), CASE (conv_id * 7 + turn * 3) % {len(SAID)} {quoted} END) AS text FROM conversations)"

    def fires(rules: tuple) -> str:
        return "(" + " OR ".join("regexp_matches(t, '" + "|".join(escaped(p) for p in phrases) + "')" for _, phrases in rules) + ")"

    stats = """st AS (SELECT phase, count(*) AS n, avg(duration) AS mean, quantile_cont(duration, 0.5) AS median, stddev_samp(duration) AS std, quantile_cont(duration, 0.25) AS q25, quantile_cont(duration, 0.75) AS q75, max(duration) AS longest,
      count(*) FILTER (censoring = 'OBSERVED') AS n_observed, count(*) FILTER (censoring = 'LEFT') AS n_left, count(*) FILTER (censoring = 'RIGHT') AS n_right, count(*) FILTER (censoring = 'BOTH') AS n_both FROM s GROUP BY phase)"""
    forward = """wc AS (SELECT a, b, count(*) AS n FROM ({pairs}) WHERE {cond} GROUP BY 1, 2),
      fw AS (SELECT g.a, g.b, coalesce(wc.n, 0) + 2.0 * pow(0.5, g.b - g.a - 1) / sum(pow(0.5, g.b - g.a - 1)) OVER (PARTITION BY g.a) AS mass FROM grid g LEFT JOIN wc ON wc.a = g.a AND wc.b = g.b WHERE g.b > g.a),
      fm AS (SELECT a, b, mass / sum(mass) OVER (PARTITION BY a) AS m FROM fw)"""
    seg_pairs = "SELECT phase AS a, lead(phase) OVER (PARTITION BY video ORDER BY seg_no) AS b FROM s"
    paired = f"""WITH {_PREDS}, {_BOOT.format(n=30)},
      acc AS (SELECT resample_id, sum(CASE WHEN (prob >= 0.5) = (label = 1) THEN k ELSE 0 END) / sum(k) AS a, sum(CASE WHEN (least(1.0, prob + 0.2) >= 0.5) = (label = 1) THEN k ELSE 0 END) / sum(k) AS b FROM bp GROUP BY 1),
      d AS (SELECT b - a AS d FROM acc), nz AS (SELECT round(abs(d), 12) AS m, d > 0 AS up FROM d WHERE d <> 0),
      rk AS (SELECT m, count(*) AS k, count(*) FILTER (up) AS u FROM nz GROUP BY m), rr AS (SELECT *, coalesce(sum(k) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS rank FROM rk)
      SELECT round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) END, 6) AS cohen_d,
        round((SELECT coalesce(sum(rank * u), 0) FROM rr), 6)::DOUBLE AS w_plus, round((SELECT coalesce(sum(rank * (k - u)), 0) FROM rr), 6)::DOUBLE AS w_minus, (SELECT coalesce(sum(k), 0)::BIGINT FROM rr) AS n_nonzero FROM d"""
    split = """vs AS (SELECT video, row_number() OVER (ORDER BY md5('split:' || video), video) / count(*) OVER () AS r FROM (SELECT DISTINCT video FROM f)),
      sp AS (SELECT video, CASE WHEN r <= 0.7 THEN 'train' WHEN r <= 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM vs)"""
    manifests = """d AS (SELECT doc_id AS document_id, md5(text) AS hash FROM documents), o AS (SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'old' ELSE hash END AS hash FROM d WHERE document_id % 7 <> 0),
      n AS (SELECT * FROM d WHERE document_id % 11 <> 0)"""
    ranges = _SEGMENTS + """, r AS (SELECT video, seg_no AS range_no, phase, start AS frame_start, "end" + 3 AS frame_end FROM s), j AS (SELECT f.video, f.frame, r.phase AS range_phase, r.range_no FROM f JOIN r ON f.video = r.video AND f.frame BETWEEN r.frame_start AND r.frame_end)"""
    best = _AUROC.format(k="phase,", part="phase", w="1", t="p", g="GROUP BY phase")
    return {
        "windows_labelled": f"WITH {_WINDOWS} SELECT video, CAST(row_number() OVER (ORDER BY video, first_frame) - 1 AS BIGINT) AS window_start, first_frame_phase, last_frame_phase, consistency_flag FROM w",
        "window_flag_counts": f"WITH {_WINDOWS} SELECT consistency_flag, count(*) AS n FROM w GROUP BY 1",
        "phase_transition_matrix": f"WITH {_WINDOWS}, {_GRID} SELECT CAST(a AS BIGINT) AS first_phase, CAST(b AS BIGINT) AS last_phase, count(w.video) AS n FROM grid LEFT JOIN w ON first_frame_phase = a AND last_frame_phase = b GROUP BY 1, 2",
        "unfiltered_windows": f"WITH {_WINDOWS} SELECT video, count(*) AS n, CAST(sum(CASE WHEN first_frame_phase <> last_frame_phase THEN 1 ELSE 0 END) AS BIGINT) AS n_changing FROM w0 WHERE n = 8 AND (first_frame - 1) % 4 = 0 GROUP BY 1",
        "window_exact_partner": f"WITH {_WINDOWS}, k AS (SELECT video, coalesce(lag(first_frame, 7) OVER (PARTITION BY video ORDER BY first_frame) = first_frame - 7, false) AS c FROM w) SELECT video, count(*) AS n, CAST(sum(CAST(c AS BIGINT)) AS BIGINT) AS n_covered FROM k GROUP BY 1",
        "range_join_annotations": f"WITH {ranges} SELECT video, range_phase, count(*) AS n FROM j GROUP BY 1, 2",
        "range_join_last_wins": f"WITH {ranges} SELECT video, frame, arg_max(range_phase, range_no) AS range_phase FROM j GROUP BY 1, 2",
        "segments": f'WITH {_SEGMENTS} SELECT video, seg_no, phase, start, "end", duration FROM s',
        "segment_censoring": f"WITH {_SEGMENTS} SELECT phase, censoring, count(*) AS n FROM s GROUP BY 1, 2",
        "segment_sanity": f'WITH {_SEGMENTS}, k AS (SELECT *, coalesce(start <> lag("end") OVER (PARTITION BY video ORDER BY seg_no) + 1, false) AS gap FROM s) SELECT phase, count(*) AS n_segments, count(DISTINCT video) AS n_videos, count(*) FILTER (gap) AS n_gaps FROM k GROUP BY 1',
        "duration_stats": f"WITH {_SEGMENTS}, {stats} SELECT phase, n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(std / mean, 6) AS cv, round(q25, 6) AS q25, round(q75, 6) AS q75, longest, n_observed, n_left, n_right, n_both FROM st",
        "dmax_strategies": f"WITH {_SEGMENTS} SELECT max(duration) AS observed_max, CAST(ceil(quantile_cont(duration, 0.99)) AS BIGINT) AS quantile_max, CAST(268 AS BIGINT) AS explicit_max FROM s",
        "cv_groups": f"WITH {_SEGMENTS}, {stats}, c2 AS (SELECT phase, std / mean AS cv FROM st), q AS (SELECT quantile_cont(cv, 1/3) AS a, quantile_cont(cv, 2/3) AS b FROM c2) SELECT phase, round(cv, 6) AS cv, CASE WHEN cv <= a THEN 'low' WHEN cv <= b THEN 'middle' WHEN cv IS NOT NULL THEN 'high' END AS cv_group FROM c2, q",
        "transition_events": f"WITH {_EVENTS} SELECT video, seg_no, from_phase, to_phase, window_start, window_end, distance, is_skip FROM e",
        "phase_skips_returns_regressions": f"WITH {_EVENTS} SELECT video, seg_no, from_phase, to_phase, CAST(distance >= 2 AS BIGINT) AS is_forward_skip, CAST(distance < 0 AS BIGINT) AS is_regression, CAST(EXISTS (SELECT 1 FROM e b WHERE b.video = e.video AND b.seg_no < e.seg_no AND b.from_phase = e.to_phase) AS BIGINT) AS is_return FROM e",
        "asof_last_next_transition": f"""WITH {_EVENTS} SELECT f.video, f.frame, l.window_end AS last_at, l.from_phase AS last_from, l.to_phase AS last_to, n.window_end AS next_at, n.from_phase AS next_from, n.to_phase AS next_to
            FROM f ASOF LEFT JOIN e l ON f.video = l.video AND f.frame >= l.window_end ASOF LEFT JOIN e n ON f.video = n.video AND f.frame < n.window_end""",
        "events_at_frame": f"WITH {_EVENTS} SELECT video, from_phase, to_phase, window_start, window_end FROM e WHERE 13 BETWEEN window_start AND window_end",
        "history_band": f"""WITH {_FRAMES}{_CENTRES}, k AS (SELECT f.*, c.centre, max(frame) OVER (PARTITION BY video) AS n FROM f JOIN ctr c USING (video))
            SELECT video, frame, phase, frame - centre AS offset_from_center, CAST(centre - 5 < 1 OR centre + 5 > n AS BIGINT) AS truncated FROM k WHERE frame - centre BETWEEN -5 AND 5""",
        "stability_after_centre": f"""WITH {_FRAMES}{_CENTRES}, k AS (SELECT f.video, f.frame, f.phase, c.centre, max(CASE WHEN frame = centre THEN phase END) OVER (PARTITION BY f.video) AS mid FROM f JOIN ctr c USING (video))
            SELECT video, count(*) FILTER (frame > centre) AS n_after, CAST(count(*) FILTER (frame > centre) > 0 AND count(*) FILTER (frame > centre AND phase <> mid) = 0 AS BIGINT) AS is_stable FROM k GROUP BY 1""",
        "timeline_segments": f'WITH {_SEGMENTS} SELECT video, CAST(seg_no AS BIGINT) AS seg_no, min(phase) AS phase, min(frame) AS start, max(frame) AS "end", round(avg(value / 1000), 9) AS mean_score FROM g GROUP BY 1, 2',
        "change_points": f"WITH {_FRAMES}, k AS (SELECT lag(phase) OVER (PARTITION BY video ORDER BY frame) AS before, phase AS after FROM f) SELECT before, after, count(*) AS n FROM k WHERE before <> after GROUP BY 1, 2",
        "model_observed_lag": f"""WITH {_EVENTS}, b AS (SELECT video, from_phase, to_phase, window_end + seg_no % 5 AS b_at FROM e WHERE seg_no % 2 = 0), m AS (SELECT e.video, min((e.window_end, b.b_at, e.from_phase, e.to_phase)) AS m FROM e JOIN b USING (video, from_phase, to_phase) GROUP BY 1)
            SELECT v.video, m.m[3] AS from_phase, m.m[4] AS to_phase, m.m[2] - m.m[1] AS lag FROM (SELECT DISTINCT video FROM e) v LEFT JOIN m USING (video)""",
        "series_gap_extrema": f"""WITH {_SCORES}, k AS (SELECT *, abs(first - second) AS gap FROM sc)
            SELECT video, round(min(gap), 6) AS min_gap, arg_min(frame, (gap, frame)) AS min_gap_at, round(max(gap), 6) AS max_gap, arg_min(frame, (-gap, frame)) AS max_gap_at,
              round(avg(gap) FILTER (frame <= 12), 6) AS mean_gap_near, round(avg(gap) FILTER (frame > 12), 6) AS mean_gap_far FROM k GROUP BY 1""",
        "series_convergence": f"""WITH {_SCORES}, k AS (SELECT *, abs(first - second) AS gap, sign(first - second) AS lead FROM sc),
            k2 AS (SELECT *, lead <> lag(lead) OVER o AS crosses, coalesce(gap < lag(gap) OVER o, false) AS falls FROM k WINDOW o AS (PARTITION BY video ORDER BY frame)),
            k3 AS (SELECT *, min(CASE WHEN crosses THEN frame END) OVER (PARTITION BY video) AS crossing FROM k2), k4 AS (SELECT * FROM k3 WHERE frame < crossing),
            k5 AS (SELECT *, coalesce(min(CAST(falls AS INT)) OVER (PARTITION BY video ORDER BY frame DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS run FROM k4)
            SELECT video, min(crossing) AS crossing, min(frame) AS converging_from, count(*) AS run_length FROM k5 WHERE run = 1 GROUP BY 1""",
        "hmm_initial": f"WITH {_FRAMES}, i AS (SELECT phase, count(*) AS k FROM f WHERE frame = 1 GROUP BY 1) SELECT CAST(r.range AS BIGINT) AS phase, round(coalesce(k, 0) / (SELECT sum(k) FROM i), 6) AS p FROM range(15) r LEFT JOIN i ON i.phase = r.range",
        "hmm_transition_matrix": f"""WITH {_SEGMENTS}, {_GRID}, {forward.format(pairs=seg_pairs, cond="b >= a")},
            st AS (SELECT a, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same, count(*) AS tot FROM (SELECT phase AS a, lead(phase) OVER (PARTITION BY video ORDER BY frame) AS b FROM f) WHERE b >= a GROUP BY 1),
            k AS (SELECT g.a, g.b, fm.m, CASE WHEN st.tot > 0 AND g.a < 14 THEN st.same / st.tot ELSE 1.0 END AS keep FROM grid g LEFT JOIN fm ON fm.a = g.a AND fm.b = g.b LEFT JOIN st ON st.a = g.a)
            SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(CASE WHEN a = b THEN keep WHEN b > a THEN (1 - keep) * coalesce(m, 0) ELSE 0.0 END, 6)::DOUBLE AS p FROM k""",
        "semi_hmm_transition_matrix": f"WITH {_SEGMENTS}, {_GRID}, {forward.format(pairs=seg_pairs, cond='b > a')} SELECT CAST(g.a AS BIGINT) AS a, CAST(g.b AS BIGINT) AS b, round(coalesce(m, 0), 6)::DOUBLE AS p FROM grid g LEFT JOIN fm ON fm.a = g.a AND fm.b = g.b",
        "state_prior": f"WITH {_FRAMES}, i AS (SELECT phase, count(*) AS k FROM f GROUP BY 1) SELECT CAST(r.range AS BIGINT) AS phase, round((coalesce(k, 0) + 1.0::DOUBLE) / ((SELECT sum(k) FROM i) + 15), 6) AS p FROM range(15) r LEFT JOIN i ON i.phase = r.range",
        "base_rate": f"WITH {_WINDOWS} SELECT round(coalesce(avg(consistency_flag), 0.5), 6) AS base_rate FROM w",
        "empirical_durations": f"""WITH {_SEGMENTS}, k AS (SELECT phase, least(duration, 24) AS d, count(*) AS k FROM s WHERE censoring = 'OBSERVED' GROUP BY 1, 2),
            gr AS (SELECT a.range AS phase, b.range + 1 AS d, coalesce(k.k, 0) AS k FROM range(15) a, range(24) b LEFT JOIN k ON k.phase = a.range AND k.d = b.range + 1),
            t AS (SELECT *, sum(k) OVER (PARTITION BY phase) AS tot FROM gr), pp AS (SELECT phase, d, CASE WHEN tot > 0 THEN (k + 0.001::DOUBLE) / (tot + 24 * 0.001::DOUBLE) ELSE 1.0::DOUBLE / 24 END AS p FROM t),
            cd AS (SELECT *, sum(p) OVER (PARTITION BY phase ORDER BY d) / sum(p) OVER (PARTITION BY phase) AS cdf FROM pp)
            SELECT CAST(phase AS BIGINT) AS phase, round(sum(d * p) / sum(p), 6) AS expected, CAST(min(CASE WHEN cdf >= 0.5 - 1e-12 THEN d END) AS BIGINT) AS q50, CAST(min(CASE WHEN cdf >= 0.9 - 1e-12 THEN d END) AS BIGINT) AS q90 FROM cd GROUP BY 1""",
        "phase_distributions": f"""WITH {_FRAMES}, c AS (SELECT video, lpad(CAST(phase AS VARCHAR), 2, '0') AS k, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY video) AS p FROM c),
            r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY p DESC, k) AS r FROM p)
            SELECT video, max(k) FILTER (r = 1) AS leader, max(k) FILTER (r = 2) AS runner_up, round(max(p) FILTER (r = 1) - max(p) FILTER (r = 2), 6) AS gap, round(sum(-p * ln(p)), 6) AS entropy,
              round(coalesce(sum(p) FILTER (r > 3), 0), 6)::DOUBLE AS omitted_mass, count(*) FILTER (r > 3) AS omitted_count, least(count(*), 3) AS n_top FROM r GROUP BY 1""",
        "duration_quantiles": f"""WITH {_SEGMENTS}, k AS (SELECT phase, least(duration, 24) AS d, count(*) AS k FROM s WHERE censoring = 'OBSERVED' GROUP BY 1, 2),
            gr AS (SELECT a.range AS phase, b.range + 1 AS d, coalesce(k.k, 0) AS k FROM range(15) a, range(24) b LEFT JOIN k ON k.phase = a.range AND k.d = b.range + 1),
            t AS (SELECT *, sum(k) OVER (PARTITION BY phase) AS tot FROM gr), pp AS (SELECT phase, d, CASE WHEN tot > 0 THEN (k + 0.001::DOUBLE) / (tot + 24 * 0.001::DOUBLE) ELSE 1.0::DOUBLE / 24 END AS p FROM t),
            cd AS (SELECT *, sum(p) OVER (PARTITION BY phase ORDER BY d) / sum(p) OVER (PARTITION BY phase) AS cdf FROM pp)
            SELECT CAST(phase AS BIGINT) AS phase, CAST(min(CASE WHEN cdf >= 0.5 - 1e-12 THEN d END) AS BIGINT) AS q50, CAST(min(CASE WHEN cdf >= 0.9 - 1e-12 THEN d END) AS BIGINT) AS q90, CAST(arg_min(d, (-p, d)) - 1 AS BIGINT) AS mode_at FROM cd GROUP BY 1""",
        "binary_metrics": f"WITH {_PREDS} SELECT {_RATES} FROM (SELECT {_RATE.format(w=1)} FROM p)",
        "multiclass_auroc": f"WITH {_CLASSES} SELECT class, support, round(auroc, 6) AS auroc FROM (SELECT class, CAST(sum(label) AS BIGINT) AS support FROM each GROUP BY 1) JOIN {_AUROC.format(k='class,', part='class', w='1', t='each', g='GROUP BY class')} USING (class)",
        "multiclass_ranking": f"""WITH {_CLASSES}, a AS (SELECT class, support, auroc FROM (SELECT class, sum(label) AS support FROM each GROUP BY 1) JOIN {_AUROC.format(k='class,', part='class', w='1', t='each', g='GROUP BY class')} USING (class)),
            m AS (SELECT avg(auroc) AS macro, sum(auroc * support) / sum(support) AS weighted FROM a WHERE auroc IS NOT NULL),
            q AS (SELECT truth, probs, list_transform(probs, lambda p: greatest(least(p, 1 - 1e-7), 1e-7)) AS kept FROM cs)
            SELECT round(any_value(macro), 6) AS macro_auroc, round(any_value(weighted), 6) AS weighted_auroc, round(avg(-ln(kept[truth + 1] / list_sum(kept))), 6) AS log_loss,
              round(avg(CASE WHEN list_position(probs, list_max(probs)) - 1 = truth THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM q, m""",
        "window_times": f"""WITH {_TIMES} SELECT video, first_frame, CASE WHEN known = 8 THEN a END AS start_time, CASE WHEN known = 8 THEN b END AS end_time, CASE WHEN known = 8 THEN round((a + b) / 2, 3) END AS mid_time,
            CASE WHEN known = 8 THEN b - a END AS duration, n_zero_steps, CAST(known = 8 AS BIGINT) AS time_available FROM wt WHERE n = 8""",
        "aligned_truth": f"""WITH {_TIMES} SELECT first_frame_phase, last_frame_phase, count(*) AS n, round(avg(CASE WHEN known = 8 THEN b - a END), 3) AS mean_duration FROM wt WHERE n = 8 GROUP BY 1, 2""",
        "auroc_exact": f"WITH {_PREDS} SELECT round(auroc, 6) AS auroc FROM {_AUROC.format(k='', part='1', w='1', t='p', g='')}",
        "auroc_per_video": f"WITH {_PREDS} SELECT video, round(auroc, 6) AS auroc FROM {_AUROC.format(k='video,', part='video', w='1', t='p', g='GROUP BY video')}",
        "average_precision": f"""WITH {_PREDS}, k AS (SELECT prob, sum(label) AS pos, count(*) AS n FROM p GROUP BY 1), c AS (SELECT *, sum(pos) OVER o AS hits, sum(n) OVER o AS seen FROM k WINDOW o AS (ORDER BY prob DESC))
            SELECT round(sum(pos * hits / seen) / nullif(sum(pos), 0), 6) AS average_precision FROM c""",
        "log_loss": f"WITH {_PREDS}, c AS (SELECT label, greatest(least(prob, 1 - 1e-7), 1e-7) AS q FROM p) SELECT round(avg(-ln(CASE WHEN label = 1 THEN q ELSE 1 - q END)), 6) AS log_loss FROM c",
        "brier_scores": f"WITH {_PREDS} SELECT round(avg(pow(prob - label, 2)), 6) AS brier, round(avg(label) * (1 - avg(label)), 6) AS brier_constant, count(*) AS n FROM p",
        "calibration_bins": f"WITH {_PREDS}, {_EDGES} SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n, round(mean_predicted, 6) AS mean_predicted, round(mean_observed, 6) AS mean_observed FROM b",
        "ece": f"WITH {_PREDS}, {_EDGES} SELECT round(sum(n * abs(mean_predicted - mean_observed)) / sum(n), 6) AS ece FROM b WHERE n > 0",
        "murphy_decomposition": f"""WITH {_PREDS}, {_EDGES}, t AS (SELECT sum(n) AS t, sum(n * mean_observed) / sum(n) AS r FROM b WHERE n > 0),
            k AS (SELECT sum(n * pow(mean_predicted - mean_observed, 2)) / max(t) AS rel, sum(n * pow(mean_observed - r, 2)) / max(t) AS res, max(r) * (1 - max(r)) AS unc FROM b, t WHERE n > 0)
            SELECT round(rel, 6) AS reliability, round(res, 6) AS resolution, round(unc, 6) AS uncertainty, round(rel - res + unc, 6) AS decomposed FROM k""",
        "per_phase_calibration": f"WITH {_PREDS} SELECT phase, count(*) AS n, round(avg(label), 6) AS observed, round(avg(prob), 6) AS predicted, round(avg(pow(prob - label, 2)), 6) AS brier, round(avg(prob) - avg(label), 6) AS bias FROM p GROUP BY 1",
        "confusion_top4": f"WITH {_CENTROID}, k AS (SELECT actual, predicted, count(*) AS n FROM pr GROUP BY 1, 2), h AS (SELECT *, n / sum(n) OVER (PARTITION BY actual) AS share FROM k), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, actual, predicted) AS rank FROM h WHERE actual <> predicted) SELECT actual, predicted, n, round(share, 6) AS share, rank FROM r WHERE rank <= 4",
        "class_metrics": f'WITH {_CLASS} SELECT class, support, round("precision", 6)::DOUBLE AS "precision", round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM cm',
        "balanced_accuracy_macro_f1": f"WITH {_CLASS} SELECT round(sum(recall * support) / sum(support), 6)::DOUBLE AS accuracy, round(avg(recall) FILTER (support > 0), 6)::DOUBLE AS balanced_accuracy, round(avg(f1), 6)::DOUBLE AS macro_f1, round(sum(f1 * support) / sum(support), 6)::DOUBLE AS weighted_f1 FROM cm",
        "class_weights": f"WITH {_FRAMES}, k AS (SELECT phase AS class, count(*) AS n FROM f GROUP BY 1) SELECT class, n, round(pow(sum(n) OVER () / (count(*) OVER () * n), 0.5), 6) AS weight FROM k",
        "bootstrap_ci": f"WITH {_PREDS}, {_BOOT.format(n=50)} SELECT round(avg(auroc), 6) AS mean, round(stddev_samp(auroc), 6) AS std, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high, count(auroc) AS n FROM {_AUROC.format(k='resample_id,', part='resample_id', w='k', t='bp', g='GROUP BY resample_id')}",
        "paired_bootstrap": paired,
        "holm_bonferroni": f"""WITH {_PREDS}, t AS (SELECT video AS test, abs(avg(prob) - 0.5) / 4 AS p_value FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS rank, count(*) OVER () AS m FROM t)
            SELECT test, round(p_value, 6) AS p_value, rank, round(0.05::DOUBLE / (m - rank + 1), 6) AS threshold, min(CAST(p_value <= 0.05::DOUBLE / (m - rank + 1) AS BIGINT)) OVER (ORDER BY rank) AS rejected FROM r""",
        "pearson_spearman_partial": """WITH x AS (SELECT l_quantity AS x, round(l_extendedprice / 1000) AS y, l_discount AS z FROM lineitem),
            r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM x),
            c AS (SELECT corr(x, y) AS xy, corr(rx, ry) AS s, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM r)
            SELECT round(xy, 6) AS pearson, round(s, 6) AS spearman, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial, round(tanh(atanh(xy) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(xy) + 1.959963984540054 / sqrt(n - 3)), 6) AS high, n FROM c""",
        "select_best_config": f"""WITH {_PREDS}, a AS (SELECT * FROM {best}), m AS (SELECT phase, avg(pow(prob - label, 2)) AS brier, sum(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1 ELSE 0 END) / count(*) AS accuracy FROM p GROUP BY 1),
            k AS (SELECT phase AS config_no, auroc, brier, accuracy, coalesce(auroc >= 0.5, false) AS fit FROM a JOIN m USING (phase)), r AS (SELECT *, row_number() OVER (ORDER BY fit DESC, round(brier, 4), auroc DESC, accuracy DESC, config_no) AS rn FROM k)
            SELECT config_no, round(auroc, 6) AS auroc, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, CASE WHEN fit THEN rn END AS rank, CASE WHEN NOT fit THEN 'below the auroc floor' WHEN rn = 1 THEN 'chosen' ELSE 'eligible' END AS reason FROM r""",
        "coverage_restricted": f"""WITH {_PREDS}, b AS (SELECT 'all' AS scope, prob, label FROM p UNION ALL SELECT 'covered', prob, label FROM p WHERE doc_id - 20 IN (SELECT doc_id FROM p)), m AS (SELECT scope, {_RATE.format(w=1)} FROM b GROUP BY scope)
            SELECT scope, {_RATES}, round(auroc, 6) AS auroc FROM m JOIN {_AUROC.format(k="scope,", part="scope", w="1", t="b", g="GROUP BY scope")} USING (scope)""",
        "patient_split": f"WITH {_FRAMES}, {split} SELECT video, split FROM sp",
        "sampled_groups": f"WITH {_FRAMES}, k AS (SELECT video FROM (SELECT DISTINCT video FROM f) ORDER BY md5('sample:' || video), video LIMIT 7) SELECT video, count(*) AS n FROM f WHERE video IN (SELECT video FROM k) GROUP BY 1",
        "balanced_undersample": f"WITH {_WINDOWS}, k AS (SELECT *, row_number() OVER (PARTITION BY consistency_flag ORDER BY md5('balance:' || video || ':' || first_frame), video, first_frame) AS r FROM w), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM w GROUP BY consistency_flag)) SELECT video, first_frame, consistency_flag FROM k, m WHERE r <= m.n",
        "shuffle_control": f"WITH {_FRAMES}, o AS (SELECT video, phase, row_number() OVER (PARTITION BY video ORDER BY md5('control:' || video || ':' || frame), frame) AS r FROM f) SELECT f.video, f.frame, o.phase FROM f JOIN o ON o.video = f.video AND o.r = f.frame",
        "split_leakage": f"WITH {_FRAMES}, {split}, k AS (SELECT f.video, CASE WHEN f.video % 5 = 0 AND frame = 1 THEN 'leaked' ELSE split END AS split FROM f JOIN sp USING (video)) SELECT video, count(DISTINCT split) AS n_splits FROM k GROUP BY 1 HAVING count(DISTINCT split) > 1",
        "cosine_topk": f"WITH {cosine} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM rk WHERE rank <= 5",
        "knn_agreement": f"""WITH {cosine}, k AS (SELECT rk.query_id, a.label AS own, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS share FROM rk JOIN n a ON a.vec_id = rk.query_id JOIN n b ON b.vec_id = rk.vec_id WHERE rank <= 5 GROUP BY 1, 2)
            SELECT CAST(own AS BIGINT) AS label, count(*) AS n_queries, round(avg(share), 6) AS agreement FROM k GROUP BY 1""",
        "consecutive_distance": "WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM n) SELECT vec_id, CAST(label AS BIGINT) AS label, round(list_distance(v, b), 5) AS step FROM k",
        "vector_quality_checks": """WITH x AS (SELECT vec_id, embedding AS v FROM embeddings), d AS (SELECT i, stddev_pop(e::DOUBLE) AS s FROM (SELECT unnest(v) AS e, generate_subscripts(v, 1) AS i FROM x) GROUP BY i),
            k(c, n) AS (SELECT 'nan', count(*) FILTER (len(list_filter(v, lambda e: isnan(e))) > 0) FROM x UNION ALL SELECT 'infinite', count(*) FILTER (len(list_filter(v, lambda e: isinf(e))) > 0) FROM x UNION ALL SELECT 'zero', count(*) FILTER (len(list_filter(v, lambda e: e <> 0)) = 0) FROM x
            UNION ALL SELECT 'wrong_length', count(*) FILTER (len(v) <> 64) FROM x UNION ALL SELECT 'duplicate_vectors', count(*) - count(DISTINCT v) FROM x UNION ALL SELECT 'duplicate_ids', count(*) - count(DISTINCT vec_id) FROM x UNION ALL SELECT 'dead_dimensions', count(*) FILTER (s < 1e-8) FROM d)
            SELECT c AS "check", n AS n_bad, CAST(n = 0 AS BIGINT) AS passed FROM k""",
        "standardised_norms": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT i, avg(e) AS m, stddev_pop(e) AS s FROM x GROUP BY i) SELECT vec_id, round(sqrt(sum(pow((e - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 2))), 5) AS length FROM x JOIN d USING (i) GROUP BY 1",
        "cluster_agreement": """WITH x AS (SELECT label, vec_id % 7 AS c FROM embeddings), k AS (SELECT label, c, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS s FROM k),
            ra AS (SELECT label, sum(n) AS a FROM k GROUP BY 1), cb AS (SELECT c, sum(n) AS b FROM k GROUP BY 1), sa AS (SELECT sum(a * (a - 1) / 2) AS sa, sum(-a / t * ln(a / t)) AS ha FROM ra, t), sb AS (SELECT sum(b * (b - 1) / 2) AS sb, sum(-b / t * ln(b / t)) AS hb FROM cb, t),
            mi AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM k JOIN ra USING (label) JOIN cb USING (c), t)
            SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi FROM t, sa, sb, mi""",
        "chunk_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS hash, lower('doc_' || regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g') || '_' || doc_id) AS slug, source || '::' || lpad(CAST(doc_id % 100 AS VARCHAR), 4, '0') AS chunk_id FROM documents",
        "ingest_plan": f"WITH {manifests} SELECT document_id, CASE WHEN n.hash IS NULL THEN 'removed' WHEN o.hash IS NULL THEN 'new' WHEN n.hash = o.hash THEN 'unchanged' ELSE 'changed' END AS action FROM o FULL JOIN n USING (document_id)",
        "corpus_inventory": f"WITH {manifests} SELECT CASE WHEN o.hash IS NULL THEN 'only_found' WHEN n.hash IS NULL THEN 'only_known' ELSE 'both' END AS status, count(*) AS n FROM o FULL JOIN n USING (document_id) GROUP BY 1",
        "lexical_topk": f"WITH {lexical} SELECT query_id, block_id, score, rank FROM rk WHERE rank <= 3",
        "retrieval_metrics": f"""WITH {lexical}, h AS (SELECT query_id, rank, block_id % 50 AS d, block_id % 50 < 25 AS hit FROM rk WHERE rank <= 5)
            SELECT query_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS "precision", round(count(DISTINCT CASE WHEN hit THEN d END) / 25, 6) AS recall, round(coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0), 6) AS reciprocal_rank FROM h GROUP BY 1""",
        "line_rule_compaction": f"""WITH {said_here}, u AS (SELECT conv_id * 1000 + turn AS id, min(text) AS text FROM conversations GROUP BY 1), l AS (SELECT id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM u), k AS (SELECT id, {_FOLD} AS t FROM l)
            SELECT count(DISTINCT id) AS n, count(*) AS n_lines, count(*) FILTER ({fires(LINE_RULES)} AND NOT {fires(KEEP_RULES)}) AS n_dropped FROM k""",
        "corpus_lint": """WITH k(c, n) AS (SELECT 'missing_ids', count(*) FROM (VALUES ('0'), ('1'), ('missing')) v(id) WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT doc_id) FROM documents
            UNION ALL SELECT 'empty_texts', count(*) FILTER (trim(coalesce(text, '')) = '') FROM documents UNION ALL SELECT 'placeholders', count(*) FILTER (regexp_matches(text, 'TODO|FIXME|TBD')) FROM documents UNION ALL SELECT 'line_end_spaces', count(*) FILTER (regexp_matches(text, '(?m)[ \\t]+$')) FROM documents)
            SELECT c AS "check", n AS n_bad, CAST(n = 0 AS BIGINT) AS passed FROM k""",
        "route_questions": f"WITH {said_here}, k AS (SELECT {_FOLD} AS t FROM conversations) SELECT {category} AS category, count(*) AS n, CAST(sum({_count(V.DOMAIN_TERMS)}) AS BIGINT) AS n_domain FROM k GROUP BY 1",
        "routed_category_accuracy": f"""WITH {said_here}, k AS (SELECT turn, {_FOLD} AS t FROM conversations), m AS (SELECT {category} = CASE WHEN turn % 2 = 0 THEN 'DYNAMIC_DATA' ELSE 'DOCUMENTARY' END AS same FROM k)
            SELECT count(*) AS n, count(*) FILTER (same) AS n_match, round(avg(CAST(same AS INT)), 6) AS accuracy FROM m""",
        "grounding_numbers": f"""WITH {said_here}, x AS (SELECT role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ctx FROM conversations), k AS (SELECT role, {said.format("text")} AS said, list_transform({said.format("ctx")}, lambda v: translate(v, ',−', '.-')) AS known, coalesce(ctx, '') AS ctx FROM x),
            m AS (SELECT role, len(said) AS c, len(list_filter(said, lambda v: NOT list_contains(['0', '1', '2', '3'], v) AND NOT list_contains(known, translate(v, ',−', '.-')) AND NOT contains(ctx, v))) AS u FROM k)
            SELECT role, count(*) AS n, CAST(sum(c) AS BIGINT) AS n_checked, CAST(sum(u) AS BIGINT) AS n_ungrounded, count(*) FILTER (u = 0) AS n_grounded FROM m GROUP BY 1""",
        "framing_provenance": f"WITH {said_here}, t AS (SELECT {_FOLD} AS t FROM conversations) SELECT framing, count(*) AS n FROM ({framings}) GROUP BY 1",
        "registry_listing": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment AS role FROM customer WHERE c_mktsegment = 'BUILDING'",
        "access_filtered": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer WHERE c_nationkey = 3",
        "search_page": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(concat_ws(' ', c_custkey, c_name, c_mktsegment)), 'build') ORDER BY c_custkey DESC LIMIT 10 OFFSET 10",
        "natural_order": "WITH k AS (SELECT n_name || '_' || n_nationkey AS name, lower(split_part(n_name, '_', 1)) || '_' || lpad(split_part(n_name, '_', 2), 12, '0') || '_' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0') AS k FROM nation) SELECT name, row_number() OVER (ORDER BY k, name) - 1 AS new_id FROM k",
        "change_set": "SELECT s_suppkey, s_name, round(CASE WHEN s_suppkey % 3 = 1 THEN s_acctbal * 2 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 1000000000, 'new', 1.5",
        "set_audit": "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem), b AS (SELECT DISTINCT s_suppkey AS k FROM supplier) SELECT count(a.k) AS n_left, count(b.k) AS n_right, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) FILTER (b.k IS NULL) AS n_only_left, count(*) FILTER (a.k IS NULL) AS n_only_right FROM a FULL JOIN b ON a.k = b.k",
        "run_summary": "SELECT role, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) = 0) AS n_empty, round(avg(length(coalesce(text, ''))), 6) AS mean_length, max(length(coalesce(text, ''))) AS max_length, count(*) FILTER (turn % 3 = 0) AS n_grounded, round(sum(length(text) / 8), 6) AS elapsed_total, round(max(length(text) / 8), 6) AS elapsed_max FROM conversations GROUP BY 1",
        "run_comparability": "SELECT o_orderstatus, 'o_orderpriority' AS setting, count(DISTINCT o_orderpriority) AS n_values, CAST(count(DISTINCT o_orderpriority) <= 1 AS BIGINT) AS comparable FROM orders GROUP BY 1",
        "experiment_scores": """WITH k AS (SELECT o_custkey % 50 AS q, o_orderstatus AS condition, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS p FROM orders), m AS (SELECT condition, q, sum(p) AS t, avg(p) AS m, count(*) AS n FROM k GROUP BY 1, 2),
            o AS (SELECT condition, CAST(sum(n) AS BIGINT) AS n, sum(t) AS total, avg(m) AS mean, stddev_samp(m) AS std FROM m GROUP BY 1)
            SELECT condition, n, round(total, 6) AS total, round(mean, 6) AS mean, round(std, 6) AS std, CAST(condition = (SELECT condition FROM o ORDER BY round(mean, 9) DESC, condition LIMIT 1) AS BIGINT) AS best FROM o""",
        "verdict_changes": "WITH k AS (SELECT o_totalprice > 150000 AS b, o_totalprice > 200000 AS a FROM orders) SELECT count(*) FILTER (b AND NOT a) AS freed, count(*) FILTER (a AND NOT b) AS tightened, count(*) FILTER (a AND b) AS still_flagged, count(*) AS n FROM k",
    }


SQL = _build()
