"""What an answer is given to read: chosen chunks, rendered lines and their classes, projections to one side, provenance, pairs of contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators.audit import canonical_hash, forbidden, json_leaves
from phaseloom.operators.grounding import any_of, folded


def line_class(line: Column, prefixes: dict[str, tuple[str, ...]], rest: str = "identifiers") -> Column:
    """The first class with a prefix that the path of a `path = value` line begins with; else `rest`, for null too."""
    path = F.substring_index(line, " = ", 1)
    out = F.lit(rest)
    for name, starts in reversed(list(prefixes.items())):
        fits = F.lit(False)
        for p in starts:
            fits |= F.startswith(path, F.lit(p))
        out = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(out)
    return out


def enriched(questions: DataFrame, text: str, phases: str, triggers: tuple[str, ...]) -> DataFrame:
    """Adds search_text: the question, followed by the context's phases (each once, in order) if it holds a trigger and there are any."""
    known = F.array_compact(F.array_distinct(F.coalesce(phases, F.array().cast("array<string>"))))
    adds = any_of(folded(F.col(text)), triggers) & (F.size(known) > 0)
    return questions.withColumn("search_text", F.when(adds, F.concat_ws(" ", F.col(text), F.array_join(known, " "))).otherwise(F.col(text)))


def in_order(text: Column, head: tuple[str, ...], tail: tuple[str, ...]) -> Column:
    """Whether the first places of all head words come in order and any tail word stands after the last of them."""
    at = [F.locate(h, text) for h in head]
    ok = at[0] > 0
    for a, b in zip(at, at[1:]):
        ok &= b > a
    rest = F.substring(text, at[-1], F.length(text))
    after = F.lit(False)
    for t in tail:
        after |= F.contains(rest, F.lit(t))
    return F.coalesce(ok & after, F.lit(False))


def first_rank(ranked: DataFrame, key: str, fits: Column) -> DataFrame:
    """key, rank of the first row that fits; null where none does."""
    return ranked.groupBy(key).agg(F.min(F.when(fits, F.col("rank"))).alias("rank"))


def curated(ranked: DataFrame, key: str, rule: Column, keep: int) -> DataFrame:
    """Adds rule and decision (skipped, kept, not_needed): along the ranks of a key the first `keep` rows without a rule are kept, each row says what became of it."""
    rows = ranked.withColumn("rule", rule)
    free = F.count_if(F.col("rule").isNull()).over(W.partitionBy(key).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("decision", F.when(F.col("rule").isNotNull(), "skipped").when(free <= keep, "kept").otherwise("not_needed"))


def allowed_only(rows: DataFrame, key: str, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """key, path, value, is_kept of every leaf of a JSON text: kept if its path is, or lies below, an allowed one; list places do not matter."""
    plain = F.regexp_replace("path", r"\[\d+\]", "")
    fits = F.lit(False)
    for a in allowed:
        fits |= (plain == a) | F.startswith(plain, F.lit(a + "."))
    return json_leaves(rows, key, column).withColumn("is_kept", fits)


def one_side(series: DataFrame, common: list[str], own: list[str]) -> DataFrame:
    """A series restricted to one side's columns, with `changed` re-derived from that side's first column alone (false at a video's start)."""
    rows = series.select(*common, *own)
    before = F.lag(own[0]).over(W.partitionBy(common[0]).orderBy(common[1]))
    return rows.withColumn("changed", F.coalesce(before != F.col(own[0]), F.lit(False)))


def provenance(tokens: DataFrame, key: str) -> DataFrame:
    """key, class, tokens (sorted, each once), n (with repeats) of (key, class, token); null tokens only make the class available."""
    return tokens.filter("class is not null").groupBy(key, "class").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.count("token").alias("n"))


def paired_audit(full: DataFrame, part: DataFrame, key: str, same: list[str], payload: str, banned: list[str]) -> DataFrame:
    """key, same_<column>, same_payload (JSON, whatever the order of keys), n_leaks (paths of the part below a banned key) and passed, of contexts that differ in one side only.

    Keys must be unique; one that a side lacks fails. Nulls on both sides are the same.
    """
    def side(rows: DataFrame, name: str) -> DataFrame:
        hashed = canonical_hash(rows, key, payload)
        return rows.select(key, *[F.col(c).alias(f"{name}_{c}") for c in same]).join(hashed.withColumnRenamed("hash", f"{name}_hash"), key, "left").withColumn(f"in_{name}", F.lit(True))

    leaks = forbidden(part, key, payload, banned).groupBy(key).agg(F.count(F.lit(1)).alias("n_leaks"))
    both = side(full, "full").join(side(part, "part"), key, "full_outer").join(leaks, key, "left").na.fill(0, ["n_leaks"])
    there = F.coalesce(F.col("in_full") & F.col("in_part"), F.lit(False))
    checks = {f"same_{c}": there & F.col(f"full_{c}").eqNullSafe(F.col(f"part_{c}")) for c in same}
    checks["same_payload"] = there & F.col("full_hash").eqNullSafe(F.col("part_hash"))
    passed = F.col("n_leaks") == 0
    for c in checks.values():
        passed &= c
    return both.select(key, *[c.alias(n) for n, c in checks.items()], "n_leaks", passed.alias("passed"))


def rendered(series: DataFrame) -> DataFrame:
    """video, lines: `W<frame> <phase> p=<score, 3 places>` of (video, frame, phase, score) in order; a null score is left out. One line for each row: lines stay rows."""
    score = F.concat(F.lit(" p="), F.format_string("%.3f", F.col("score").cast("double")))
    return series.select("video", "frame", F.concat(F.lit("W"), F.col("frame").cast("string"), F.lit(" "), F.coalesce(F.col("phase").cast("string"), F.lit("?")), F.when(F.col("score").isNotNull(), score).otherwise("")).alias("line"))
