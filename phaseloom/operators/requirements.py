"""Audit of a corpus against what it must hold and must not say: one pass over the texts, one row for each check."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Requirements:
    """Parameters of an audit. Patterns are regular expressions; fragments are looked for as they are, in texts whose lines are joined."""

    min_chars: int = 1
    metadata: tuple[str, ...] = ()  # keys of lines `- **key:** value` that each text must have
    expected: dict[str, str] = field(default_factory=dict)  # values that such a key must have where a text has it
    hash_key: str = "source_sha256"
    fragments: dict[str, tuple[str, ...]] = field(default_factory=dict)  # by check: each must stand in some text
    identifiers: dict[str, tuple[str, int]] = field(default_factory=dict)  # by check: pattern, and how many different finds the corpus needs
    pages: int = 1000
    tables: int = 1000
    figures: int = 1000
    forbidden: dict[str, tuple[str, ...]] = field(default_factory=dict)  # by check: patterns that no text may match
    timed: tuple[str, ...] = ()  # names of times, whose numbers need a unit in their line
    unit: str = r"h\b|hours?\b|%"
    identifier: str = r"[A-Z]{2}\d*-[A-Z0-9-]+"  # is no number of a line
    medians: tuple[tuple[int, int], ...] = ()  # pairs that must not be joined to a range


def squeezed(text: Column) -> Column:
    """A text on one line: quote marks at line beginnings gone, runs of white space one space."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.trim(F.regexp_replace(line, r"^\s*>+\s?", "")))
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))


def metadata_value(text: Column, key: str) -> Column:
    """The value of the first `- **key:** value` line, a note in brackets after the key aside; null without such a line."""
    pattern = rf"(?m)^[ \t]*-[ \t]+\*\*{key}(?:[ \t]*\([^)\n]*\))?:\*\*[ \t]*([^\n]*)$"
    return F.when(F.rlike(text, F.lit(pattern)), F.trim(F.regexp_extract(text, pattern, 1)))


def _outside(text: Column, pattern: str, most: int) -> Column:
    """How many numbers that a pattern finds are not 1 to `most`."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: ~n.cast("int").between(1, most)))


def _unitless(text: Column, rules: Requirements) -> Column:
    """How many lines, headings aside, name a time and a number of two or three digits but no unit."""
    named = "|".join(f"\\Q{t}\\E" for t in rules.timed)

    def suspect(line: Column) -> Column:
        own = F.regexp_replace(line, rules.identifier, "")
        return ~F.startswith(F.ltrim(line), F.lit("#")) & F.rlike(own, F.lit(named)) & F.rlike(own, F.lit(r"\b\d{2,3}\b")) & ~F.rlike(own, F.lit(rules.unit))

    return F.size(F.filter(F.split(text, "\r?\n"), suspect)) if rules.timed else F.lit(0)


def audit(corpus: DataFrame, key: str, text: str, rules: Requirements, sources: DataFrame | None = None, elsewhere: DataFrame | None = None) -> DataFrame:
    """check, n_bad, passed of texts: short texts, metadata lacking or wrong, fragments and identifiers lacking in the corpus, page, table and figure numbers out of range,
    forbidden phrases, times without unit, medians joined to ranges; with `sources` (key, sha256) hashes that differ from what is declared or have no source; with `elsewhere` (key) texts that are listed there.

    A null text is empty. Repeated rows count each time. An empty corpus lacks all its fragments and identifiers, and nothing else.
    """
    rows = corpus.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("s", squeezed(F.col("t")))
    checks: dict[str, Column] = {"short_texts": F.count_if(F.length("t") < rules.min_chars)}
    for name in rules.metadata:
        checks[f"no_{name}"] = F.count_if(metadata_value(F.col("t"), name).isNull())
    for name, value in rules.expected.items():
        checks[f"wrong_{name}"] = F.count_if(metadata_value(F.col("t"), name) != value)
    for name, parts in rules.fragments.items():
        checks[name] = sum((1 - F.coalesce(F.max(F.contains("s", F.lit(p)).cast("long")), F.lit(0)) for p in parts), F.lit(0))
    checks["pages_out_of_range"] = F.sum(_outside(F.col("t"), r"\bpp?\.[ \t]*(\d{1,3})", rules.pages) + _outside(F.col("t"), r"\bpp\.[ \t]*\d{1,3}[–-](\d{1,3})", rules.pages))
    checks["tables_out_of_range"] = F.sum(_outside(F.col("t"), r"\bTable[ \t]+(\d{1,2})\b", rules.tables))
    checks["figures_out_of_range"] = F.sum(_outside(F.col("t"), r"\bFigure[ \t]+(\d{1,2})\b", rules.figures))
    for name, patterns in rules.forbidden.items():
        checks[name] = F.count_if(F.rlike("s", F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))))
    checks["times_without_unit"] = F.sum(_unitless(F.col("t"), rules))
    joined = [rf"\b{a}[ \t]*[–-][ \t]*{b}[ \t]*hpi" for a, b in rules.medians if a != b]
    checks["medians_as_ranges"] = F.count_if(F.rlike("t", F.lit("|".join(joined)))) if joined else F.lit(0)
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in checks.items()])
    names = list(checks)
    for name, (pattern, least) in rules.identifiers.items():
        found = rows.select(F.explode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("id")).distinct()
        one = one.join(F.broadcast(found.agg(F.greatest(F.lit(least) - F.count(F.lit(1)), F.lit(0)).cast("long").alias(name))))
        names.append(name)
    if sources is not None:
        declared = F.trim(F.regexp_replace(metadata_value(F.col("t"), rules.hash_key), "`", ""))
        met = rows.select("_key", declared.alias("said")).join(sources.select(F.col(key).alias("_key"), F.lower("sha256").alias("real")), "_key", "left")
        one = one.join(F.broadcast(met.agg(F.count_if(~F.coalesce(F.col("said") == F.col("real"), F.lit(False))).alias("hash_differs"))))
        names.append("hash_differs")
    if elsewhere is not None:
        listed = rows.join(elsewhere.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")
        one = one.join(F.broadcast(listed.agg(F.count(F.lit(1)).alias("listed_elsewhere"))))
        names.append("listed_elsewhere")
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n_bad")) for c in names]))
    return one.select(parts.alias("x")).select("x.*").withColumn("passed", (F.col("n_bad") == 0).cast("long"))
