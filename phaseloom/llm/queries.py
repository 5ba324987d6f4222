"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.annsearch import search
from phaseloom.llm.bytebpe import encode
from phaseloom.llm.common import table, word_count
from phaseloom.llm.filteraudit import audit
from phaseloom.llm.maskrank import LOWER, UPPER, rank_documents
from phaseloom.llm.media import document_media, page_media
from phaseloom.llm.mixing import digits_of, mix
from phaseloom.llm.packing import pack
from phaseloom.llm.quality import quality
from phaseloom.llm.simhash import near_duplicates
from phaseloom.llm.superkmer import dedup_substrings
from phaseloom.llm.tokens import length_histogram
from phaseloom.llm.toxicity import toxicity
from phaseloom.llm.urlcascade import ALLOW, BLOCK, filter_urls

#: The rules of the URL filter's query: action, host and path.
URL_RULES = [(ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mix(table(spark, sf_dir, "documents"), importance=digits_of(word_count(F.col("text"))))
    return mixture.select("doc_id", "size", "source_size", "target", "taken")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op5_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_media_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only, held against an independent reading of the pages in tests: all pages as sequences of texts and media."""
    found = page_media(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), F.col("position").cast("long").alias("position"), "kind", F.sha2("text", 256).alias("text_sha256"), "caption", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), decoded=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filter, op2_substring_dedup, op3_source_mix, op4_nearest_vectors, op5_token_lengths, op6_simhash_dedup, op7_media_documents, media_pages, op8_packing, op9_quality, op10_toxicity, op11_byte_bpe, op12_filter_audit, op13_lexical_ranking]
    return {f.__name__: f for f in found}


_URLS = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule, rule_host, rule_path, action) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), hits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT split.page_id, host, path, hits.rule AS rule, coalesce(hits.action, 'allow') AS verdict
FROM split LEFT JOIN hits ON split.page_id = hits.page_id
"""


_DEDUP = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

_MIX = """
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
wt AS (SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS BIGINT) AS w FROM src),
lv AS (SELECT *, sum(total) OVER () AS t, 3 * sum(total) OVER o AS below, sum(w) OVER () - sum(w) OVER o AS above FROM wt WINDOW o AS (ORDER BY total * 3 / w, place ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, below * w + 3 * total * above <= t * w AS stops FROM lv),
tg AS (SELECT source, total, CASE WHEN stops THEN 3.0::DOUBLE * total ELSE least(w * CAST(t - coalesce(sum(3 * total) FILTER (stops) OVER (), 0) AS DOUBLE) / sum(w) FILTER (NOT stops) OVER (), 3.0::DOUBLE * total) END AS target FROM st),
sw AS (SELECT *, CAST(length(bin(size)) AS BIGINT) AS v FROM s),
cl AS (SELECT source, v, CAST(sum(size) AS BIGINT) AS s FROM sw GROUP BY source, v),
cf AS (SELECT cl.*, total, target, 3 * (v * sum(s) OVER d + sum(s * v) OVER (PARTITION BY cl.source) - sum(s * v) OVER d) <= target * v AS "full"
  FROM cl JOIN tg ON cl.source IS NOT DISTINCT FROM tg.source WINDOW d AS (PARTITION BY cl.source ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT source, total, target, min(v) FILTER ("full") AS full_from,
  coalesce((target - coalesce(sum(3 * s) FILTER ("full"), 0)) / nullif(sum(s * v) FILTER (NOT "full"), 0), 0.0::DOUBLE) AS per_weight FROM cf GROUP BY source, total, target),
r AS (SELECT sw.*, total, target, CASE WHEN total > 0 AND coalesce(v >= full_from, false) THEN 3.0::DOUBLE ELSE least(v * per_weight, 3.0::DOUBLE) END AS expected
  FROM sw JOIN pr ON sw.source IS NOT DISTINCT FROM pr.source),
e AS (SELECT *, floor(expected) AS whole,
  (CAST('0x' || substr(md5('mix' || concat_ws(':', doc_id, size)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM r),
f AS (SELECT *, greatest(least(expected - whole, 1 - 1e-9), 1e-9) AS p FROM e),
o AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS o FROM f),
k AS (SELECT *, CASE WHEN whole < 3 THEN o / (1 + o) END AS rank, coalesce(doc_id, 9223372036854775807) AS id, target - sum(whole * size) OVER (PARTITION BY source) AS rest FROM o),
c AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS FIRST, id, size ROWS UNBOUNDED PRECEDING) END AS cum FROM k),
l AS (SELECT source, max((rank, id, size)) FILTER (cum <= rest) AS last, max(rest) - coalesce(max(cum) FILTER (cum <= rest), 0) AS gap FROM c GROUP BY source),
d AS (SELECT c.*, l.last, l.gap, rank IS NOT NULL AND l.last IS NOT NULL AND (rank, id, size) <= l.last AS more FROM c JOIN l ON c.source IS NOT DISTINCT FROM l.source),
b AS (SELECT source, min((abs(gap - size), rank, id, size)) AS best, any_value(gap) AS gap FROM d WHERE rank IS NOT NULL AND NOT more AND size > 0 GROUP BY source)
SELECT doc_id, size, total AS source_size, target, CAST(size * (whole + CASE WHEN more OR coalesce(b.best[1] < b.gap AND (rank, id, size) = (b.best[2], b.best[3], b.best[4]), false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""


_AUDIT = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
   coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM orders, letters WHERE instr(filter_order, l) = 0),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, instr('ABCDE', substr(filter_order, CAST(step AS INTEGER), 1)) AS own,
  [instr('ABCDE', x) FOR x IN string_split(substr(filter_order, 1, CAST(step AS INTEGER) - 1), '') IF x <> ''] AS before FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5),
e AS (SELECT part, filter_order, step, own, good, toxic, n, fails[own] AS failing, len([i FOR i IN before IF fails[i]]) > 0 AS gone, len([x FOR x IN fails IF x]) = 1 AS single FROM c, steps),
a AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
  coalesce(sum(n) FILTER (failing AND single), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS good_lost,
  coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost FROM e GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""

_RANKING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(terms)) AS l FROM d WHERE len(terms) > 0),
m AS (SELECT doc_id, terms, CAST(10 + (90 * len(terms) * docs) // l AS BIGINT) AS m FROM d, s WHERE len(terms) > 0),
tf AS (SELECT row_id, doc_id, m, term, count(*) AS tf FROM (SELECT row_number() OVER () AS row_id, doc_id, m, unnest(terms) AS term FROM m) GROUP BY ALL),
tfs AS (SELECT doc_id, m, term, CAST(sum(tf) AS BIGINT) AS tf FROM tf WHERE term IN (SELECT term FROM b) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, s),
sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM b JOIN w USING (term) JOIN tfs USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are held against brute force in tests."""
    return {"op1_url_filter": _URLS, "op2_substring_dedup": _DEDUP, "op3_source_mix": _MIX, "op12_filter_audit": _AUDIT, "op13_lexical_ranking": _RANKING}
