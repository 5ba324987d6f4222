"""Token counts: encoding with a public word-level BPE vocabulary and the exact histogram of encoded lengths."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed
from phaseloom.llm.textscan import CHUNK, KEPT, column_slices
from phaseloom.llm.wordbpe import WordEncoder

VOCABULARY = "word_bpe_49k.json"

#: About so many bytes of text are encoded at a time: the more, the fewer of their words are different.
ENCODED = 4 * CHUNK


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file; it is read in place, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)


KEPT.append(encoder)


def encoded_lengths(docs: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """n_tokens and n_docs, partly summed: one row for each length within a batch of texts."""
    path = tokenizer_path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lengths = [enc.lengths(part) for *_, part in column_slices(batch.column(0), ENCODED)]
            found = pa.array(np.concatenate([np.zeros(0, np.int64), *lengths])).value_counts()
            yield pa.record_batch([found.field(0), found.field(1)], names=["n_tokens", "n_docs"])

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer_path: str | None = None, block: int = 64) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums.

    One row for each length that occurs: n_tokens, n_docs, docs_at_least and tokens_at_least (documents of this length or
    more, and their tokens), truncated_tokens (tokens of the whole table if every document were cut to this length),
    docs_below. A null or empty text has length 0. An empty table gives no rows.

    Documents are aggregated by length before anything is shuffled, so the table that is left has as many rows as there are
    lengths. Suffix sums run in two steps, within blocks of `block` lengths and over the blocks' totals.
    """
    hist = checkpointed(encoded_lengths(docs, text_col, tokenizer_path).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / block))
    hist = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    from_here = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    totals = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = totals.select(
        "block",
        F.coalesce(F.sum("d").over(from_here), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(from_here), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(W.partitionBy()).alias("all_docs"),
        F.sum("t").over(W.partitionBy()).alias("all_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    hist = hist.join(after, "block")
    docs_ge = F.sum("n_docs").over(inside) + F.col("docs_after")
    tokens_ge = F.sum("tokens").over(inside) + F.col("tokens_after")
    return hist.select("n_tokens", "n_docs", docs_ge.alias("docs_at_least"), tokens_ge.alias("tokens_at_least"), "all_docs", "all_tokens").select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, total_tokens and docs_cut for any context limits, from the histogram alone; an empty histogram gives zeros."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    kept = F.least(F.col("n_tokens"), F.col("context_limit")) * F.col("n_docs")
    cut = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs"))
    spread = histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit"))
    sums = spread.groupBy("context_limit").agg(F.sum(kept).alias("total_tokens"), F.sum(cut).alias("docs_cut"))
    return asked.join(sums, "context_limit", "left").na.fill(0)


def length_quantiles(histogram: DataFrame, levels: list[float]) -> DataFrame:
    """level and n_tokens: the least length that at least that share of the documents does not exceed; no rows for an empty histogram."""
    reached = (F.col("docs_below") + F.col("n_docs")) / (F.col("docs_below") + F.col("docs_at_least"))
    each = histogram.select("n_tokens", reached.alias("reached"), F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    return each.filter("reached >= level").groupBy("level").agg(F.min("n_tokens").alias("n_tokens"))
