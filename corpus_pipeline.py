"""A corpus pipeline of training-data operators: toxic documents out, near-duplicates out, repeated passages out, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm import mixing, packing, simhash, superkmer, toxicity
from phaseloom.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the models learn from the labels that are not held out. Null and empty texts stay, repeated rows share their fate."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", ~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of smallest id; a group without any id keeps one row. Rows that share an id are told apart by their texts. Null and empty texts are one group."""
    return simhash.without_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier elsewhere; a document of which nothing is left goes. `n_chars`, if there is one, follows the text."""
    kept = superkmer.dedup_substrings(docs, carried=tuple(docs.columns), joined=False)
    kept = kept.filter("n_words = 0 or n_removed < n_words")
    own = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars"))
    return kept.select(*[own.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, some of them up to three times; a null source is one, and documents without words may go."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; every row is a document of its own, one without words is its end token."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; an empty table gives no rows, other columns travel along. Each stage's result is written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, windows of words and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
