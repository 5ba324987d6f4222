"""Text corpora: identity, incremental ingest, chunks, lexical search, retrieval scores, rule-based compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.functions import vocabulary as V
from phaseloom.operators.grounding import folded


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def slug(name: Column) -> Column:
    """A file's stem in lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def chunk_id(document: Column, number: Column) -> Column:
    return F.concat(document, F.lit("::"), F.lpad(number.cast("string"), 4, "0"))


def inventory(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, status: in both lists, only known or only found."""
    a = known.select(key).distinct().withColumn("_a", F.lit(True))
    b = found.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "only_found").when(F.col("_b").isNull(), "only_known").otherwise("both").alias("status"))


def ingest_plan(manifest: DataFrame, current: DataFrame, version_changed: bool = False) -> DataFrame:
    """document_id, action of (document_id, hash) tables: new, changed, unchanged, removed; a new embedding version re-reads all that stay."""
    old = manifest.select("document_id", F.col("hash").alias("_old"))
    new = current.select("document_id", F.col("hash").alias("_new"))
    same = F.lit(not version_changed) & (F.col("_old") == F.col("_new"))
    action = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "new").when(same, "unchanged").when(F.lit(version_changed) & (F.col("_old") == F.col("_new")), "version_bumped").otherwise("changed")
    return old.join(new, "document_id", "full_outer").select("document_id", action.alias("action"))


def sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_no, heading, level, body of markdown: a heading line opens a section, what stands before the first is `(intro)`, level 0; sections without body vanish.

    Heading lines inside a code fence open a section as well.
    """
    lines = documents.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("line_no", "line"))
    is_head = F.rlike("line", F.lit(r"^#{1,6}\s+"))
    number = F.sum(is_head.cast("long")).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("is_head", is_head).withColumn("section_no", number)
    out = rows.groupBy(key, "section_no").agg(
        F.max(F.when(F.col("is_head"), F.col("line"))).alias("head"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "line")))), lambda s: s["line"]), "\n")).alias("body"),
    )
    heading = F.coalesce(F.nullif(F.trim(F.regexp_replace("head", r"^#{1,6}\s+", "")), F.lit("")), F.lit("(intro)"))
    level = F.coalesce(F.length(F.regexp_extract("head", "^(#{1,6})", 1)), F.lit(0)).cast("long")
    return out.filter(F.regexp_replace("body", r"\s+", "") != "").select(key, "section_no", heading.alias("heading"), level.alias("level"), F.regexp_replace("body", r"^\n+|\n+$", "").alias("body"))


def blocks(parts: DataFrame, key: str) -> DataFrame:
    """key, section_no, block_no, block, is_atomic: fenced code and runs of table lines stay whole, prose is cut at blank lines."""
    lines = parts.select(key, "section_no", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    along = W.partitionBy(key, "section_no").orderBy("line_no")
    fence = F.rlike("line", F.lit(r"^\s*```")).cast("long")
    count = F.sum(fence).over(along.rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("fence", fence).withColumn("inside", (count % 2 == 1) | (fence == 1))
    kind = F.when(F.col("inside"), "code").when(F.rlike("line", F.lit(r"^\s*\|")), "table").when(F.trim("line") == "", "blank").otherwise("prose")
    lines = lines.withColumn("kind", kind)
    opens = (F.col("kind") != F.lag("kind").over(along)) | ((F.col("kind") == "code") & (F.col("fence") == 1) & F.col("inside") & (F.lag("fence").over(along) == 1) & ~F.coalesce(F.lag("inside").over(along), F.lit(False)))
    number = F.sum(F.coalesce(opens, F.lit(True)).cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("run", number).filter("kind <> 'blank'")
    out = rows.groupBy(key, "section_no", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("block"), (F.first("kind") != "prose").alias("is_atomic"))
    return out.withColumn("block_no", F.row_number().over(W.partitionBy(key, "section_no").orderBy("run")).cast("long")).drop("run")


def chunks(documents: DataFrame, key: str, text: str, target: int = 1800, most: int = 2600, overlap: int = 200) -> DataFrame:
    """key, chunk_no, chunk_id, heading, content, n_chars: blocks packed in order up to `target` characters, or `most` if only the last block passes it; a block above `most` stands alone.

    Every chunk but the first of its section begins with the end of the one before, if that is prose.
    """
    parts = sections(documents, key, text)
    ordered = blocks(parts, key).groupBy(key, "section_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "block", "is_atomic"))).alias("bs"))
    empty = F.array().cast("array<struct<content:string,is_atomic:boolean>>")

    def place(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last["content"], F.lit("\n\n"), b["block"])
        fits = (F.size(acc) > 0) & (F.length(last["content"]) < target) & (F.length(joined) <= most)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(joined.alias("content"), (last["is_atomic"] & b["is_atomic"]).alias("is_atomic"))))
        return F.when(fits, merged).otherwise(F.concat(acc, F.array(F.struct(b["block"].alias("content"), b["is_atomic"].alias("is_atomic")))))

    packed = ordered.select(key, "section_no", F.posexplode(F.aggregate("bs", empty, lambda acc, b: F.when(F.size(acc) > 0, place(acc, b)).otherwise(F.array(F.struct(b["block"].alias("content"), b["is_atomic"].alias("is_atomic")))))).alias("part_no", "c"))
    packed = packed.select(key, "section_no", "part_no", "c.content", "c.is_atomic")
    before = F.lag("content").over(W.partitionBy(key, "section_no").orderBy("part_no"))
    content = F.when(before.isNotNull() & ~F.col("is_atomic"), F.concat(F.right(before, F.lit(overlap)), F.lit("\n[...]\n"), F.col("content"))).otherwise(F.col("content"))
    rows = packed.withColumn("_whole", content).join(parts.select(key, "section_no", "heading"), [key, "section_no"])
    number = F.row_number().over(W.partitionBy(key).orderBy("section_no", "part_no")) - 1
    rows = rows.withColumn("chunk_no", number.cast("long"))
    return rows.select(key, "chunk_no", chunk_id(F.col(key).cast("string"), F.col("chunk_no")).alias("chunk_id"), "heading", F.col("_whole").alias("content"), F.length("_whole").cast("long").alias("n_chars"))


def terms(text: Column) -> Column:
    """Distinct words of three or more of a-z, 0-9 and + of a folded text, without stop words."""
    return F.array_except(F.regexp_extract_all(folded(text), F.lit("[a-z0-9+]{3,}"), F.lit(0)), F.array(*[F.lit(w) for w in V.STOP_WORDS]))


def lexical_topk(queries: DataFrame, blocks_: DataFrame, k: int, query_id: str, query_text: str, block_id: str, block_text: str) -> DataFrame:
    """query_id, block_id, score, rank: shared terms over the sum of the roots of both sizes, rounded to 4 places, ties to the smaller block.

    Queries and blocks meet only at terms they share; counts are summed per pair before the k best of a query are kept.
    """
    q = queries.select(F.col(query_id).alias("query_id"), terms(F.col(query_text)).alias("t")).withColumn("nq", F.size("t"))
    b = blocks_.select(F.col(block_id).alias("block_id"), terms(F.col(block_text)).alias("t")).withColumn("nb", F.size("t"))
    pairs = q.select("query_id", "nq", F.explode("t").alias("term")).join(b.select("block_id", "nb", F.explode("t").alias("term")), "term")
    scored = pairs.groupBy("query_id", "block_id", "nq", "nb").agg(F.count(F.lit(1)).alias("shared"))
    scored = scored.withColumn("score", F.round(F.col("shared") / (F.sqrt("nq") + F.sqrt("nb")), 4))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "block_id")).cast("long")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "block_id", "score", "rank")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query_id, precision, recall, reciprocal_rank from ranked (query_id, rank, document_id) and relevant (query_id, document_id).

    Repeated documents count each time for precision and once for recall; recall is null without relevant documents; the first
    hit of the whole list counts for the reciprocal rank, none is 0.
    """
    marked = ranked.join(relevant.distinct().withColumn("hit", F.lit(1)), ["query_id", "document_id"], "left").na.fill(0, ["hit"])
    top = F.col("rank") <= k
    got = marked.groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(top, F.col("hit"))) / F.count_if(top), F.lit(0.0)).alias("precision"),
        F.count_distinct(F.when(top & (F.col("hit") == 1), F.col("document_id"))).alias("found"),
        F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
    )
    wanted = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    return got.join(wanted, "query_id", "left").select("query_id", "precision", (F.col("found") / F.col("wanted")).alias("recall"), "reciprocal_rank")


def rule_of(text: Column, rules: tuple) -> Column:
    """The first rule with a phrase that occurs in a folded text at the start of a word; null if none."""
    out = F.lit(None).cast("string")
    for name, phrases in reversed(rules):
        patterns = "|".join(("\\b" if p[0].isalnum() else "") + "".join(c if c.isalnum() or c == " " else "\\" + c for c in p) for p in phrases)
        out = F.when(F.rlike(text, F.lit(patterns)), name).otherwise(out)
    return out


def compacted(documents: DataFrame, key: str, text: str, section_rules: tuple = (), line_rules: tuple = (), keep_rules: tuple = ()) -> DataFrame:
    """By rules (name, phrases): key, text without the lines that a rule drops, n_lines, n_dropped, rules. A keep rule beats a line rule; blank lines at the ends go; a dropped first heading drops the document."""
    lines = documents.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    low = folded(F.col("line"))
    rule = F.when(rule_of(low, keep_rules).isNull(), rule_of(low, line_rules))
    head = F.when((F.col("line_no") == 0) & F.rlike("line", F.lit(r"^#{1,6}\s+")), rule_of(low, section_rules))
    rows = lines.withColumn("rule", rule).withColumn("head", head)
    out = rows.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rule").isNull(), F.struct("line_no", "line")))), lambda s: s["line"]), "\n").alias("kept"),
        F.count(F.lit(1)).alias("n_lines"), F.count("rule").alias("n_dropped"), F.array_sort(F.collect_set("rule")).alias("rules"), F.max("head").alias("head"),
    )
    kept = F.when(F.col("head").isNull(), F.regexp_replace("kept", r"^\s*\n|\n\s*$", "")).otherwise("")
    return out.select(key, kept.alias("text"), "n_lines", "n_dropped", F.when(F.col("head").isNotNull(), F.array(F.col("head"))).otherwise(F.col("rules")).alias("rules"))


def corpus_blocks(text: DataFrame, key: str, column: str) -> DataFrame:
    """key, block_id, body of `### id` headings, `- **id**` bullets and `| id |` table rows; the first form that names an id wins."""
    source = F.coalesce(F.col(column), F.lit(""))
    forms = [
        (0, F.regexp_extract_all(source, F.lit(r"(?m)^### +(\S+)"), F.lit(1)), F.regexp_extract_all(source, F.lit(r"(?s)### +\S+[^\n]*\n?(.*?)(?=\n### |\z)"), F.lit(1))),
        (1, F.regexp_extract_all(source, F.lit(r"(?m)^- \*\*([^*]+)\*\*.*$"), F.lit(1)), F.regexp_extract_all(source, F.lit(r"(?m)^- \*\*[^*]+\*\*:?\s*(.*)$"), F.lit(1))),
        (2, F.regexp_extract_all(source, F.lit(r"(?m)^\| *([A-Z]+-\d+) *\|.*$"), F.lit(1)), F.regexp_extract_all(source, F.lit(r"(?m)^\| *[A-Z]+-\d+ *\|(.*)$"), F.lit(1))),
    ]
    each = F.flatten(F.array(*[F.zip_with(ids, bodies, lambda i, b, n=n: F.struct(F.lit(n).alias("form"), i.alias("block_id"), F.trim(b).alias("body"))) for n, ids, bodies in forms]))
    rows = text.select(key, F.posexplode(each).alias("at", "x")).select(key, "at", "x.*").filter("block_id is not null")
    first = F.row_number().over(W.partitionBy(key, "block_id").orderBy("form", "at"))
    return rows.withColumn("n", first).filter("n = 1").select(key, "block_id", "body")


def locators(text: Column) -> Column:
    """Pages, tables and sections that a text cites, each once, in order, joined by `; `."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:pages?|pp?\.|tables?|sections?)\s*\d+(?:[-–]\d+)?"), F.lit(0))
    return F.array_join(F.array_distinct(found), "; ")


def lint(corpus: DataFrame, key: str, text: str, required: list[str]) -> DataFrame:
    """check, n_bad, passed of a corpus: missing ids, empty texts, repeated ids, placeholders left, spaces at line ends."""
    ids = corpus.sparkSession.createDataFrame([(x,) for x in required], "id string")
    missing = ids.join(corpus.select(F.col(key).cast("string").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing_ids"))
    again = corpus.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_ids"))
    facts = corpus.agg(
        F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("empty_texts"), F.count_if(F.rlike(F.col(text), F.lit("TODO|FIXME|TBD"))).alias("placeholders"),
        F.count_if(F.rlike(F.col(text), F.lit(r"(?m)[ \t]+$"))).alias("line_end_spaces"),
    )
    one = facts.join(F.broadcast(missing)).join(F.broadcast(again))
    names = ["missing_ids", "repeated_ids", "empty_texts", "placeholders", "line_end_spaces"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n_bad")) for c in names])).alias("x")).select("x.*").withColumn("passed", (F.col("n_bad") == 0).cast("long"))
