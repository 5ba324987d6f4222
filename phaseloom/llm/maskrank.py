"""Ranked lexical search: documents of a shard are grouped by the mask of the asked terms they hold, and masks are evaluated by descending bound."""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed
from phaseloom.llm.textscan import lean_worker, packed, text_slices, unpacked

#: Terms are maximal runs of ASCII digits and letters and of anything beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes as terms see them: letters in lower case, separators as blanks.
_SEEN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: So many pairs of item and term are asked at once; more items are asked in blocks, each of which reads the documents again.
MOST_PAIRS = 2_000_000
_N, _L = -1, -2  # codes of the number of documents with terms and of all their terms
NULL_ID = np.iinfo(np.int64).max


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; a null text has none."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)), F.array().cast("array<string>")))


def bound(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to the score, exactly; it rises with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def lengths(n: list[int], documents: int, total: int) -> np.ndarray:
    """m of documents with n terms each, of all `documents` with `total` terms; Python's integers, so that no product overflows."""
    return np.array([10 + 90 * x * documents // total for x in n], np.int64)


def _postings(codes: dict[bytes, int]):
    """Texts to rows: blobs of documents that hold asked terms (id, number of terms, codes, tf), and at a task's end its share of every count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, count = codes.keys(), Counter()
        schema = pa.schema([("blob", pa.binary()), ("code", pa.int32()), ("n", pa.int64())])
        with lean_worker():
            for batch in batches:
                ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy()
                for i, j, texts in text_slices(batch.column(1)):
                    doc, n, held, code, tf = [], [], [], [], []
                    for k, text in zip(ids[i:j].tolist(), texts, strict=True):
                        words = text.translate(_SEEN).split()
                        if not words:
                            continue
                        count[_N] += 1
                        count[_L] += len(words)
                        own = Counter(words)
                        found = own.keys() & asked
                        if not found:
                            continue
                        doc.append(k)
                        n.append(len(words))
                        held.append(len(found))
                        of = [codes[t] for t in found]
                        count.update(of)
                        code += of
                        tf += [own[t] for t in found]
                    if doc:
                        blob = packed(1, *[np.array(x, t) for x, t in zip((doc, n, held, code, tf), _TYPES, strict=True)])
                        yield pa.record_batch([pa.array([blob]), pa.array([None], pa.int32()), pa.array([None], pa.int64())], schema=schema)
            if count:
                yield pa.record_batch([pa.nulls(len(count), pa.binary()), pa.array(list(count.keys()), pa.int32()), pa.array(list(count.values()), pa.int64())], schema=schema)

    return run


_TYPES = ("<i8", "<i8", "<i4", "<i4", "<i4")


class Shard:
    """Some documents and the bitmap of each asked term over them."""

    def __init__(self, blobs: list[bytes], documents: int, total: int):
        doc, n, held, code, tf = (np.concatenate(x) for x in zip(*[unpacked(b, *_TYPES) for b in blobs], strict=True))
        self.doc, self.m, size = doc, lengths(n.tolist(), documents, total), len(doc)
        row = np.repeat(np.arange(size), held)
        self.keys = code.astype(np.int64) * size + row
        order = np.argsort(self.keys)
        self.keys, self.tf, code, row = self.keys[order], tf[order].astype(np.int64), code[order], row[order]
        self.codes, first = np.unique(code, return_index=True)
        bits = np.zeros((len(self.codes), size), bool)
        bits[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code)))), row] = True
        self.bitmaps = np.packbits(bits, axis=1)
        self.most_tf = np.maximum.reduceat(self.tf, first) if len(first) else np.zeros(0, np.int64)

    def masks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the terms at these places: each distinct mask but the empty one as a row of bits, the documents in order of their mask, and where each mask's begin."""
        held = np.bitwise_or.reduce(self.bitmaps[at], axis=0)
        some = np.flatnonzero(np.unpackbits(held, count=len(self.doc)))
        bits = np.unpackbits(self.bitmaps[at], axis=1, count=len(self.doc))[:, some]
        sides = np.packbits(bits, axis=0)
        wide = np.zeros((-len(sides) % 8 + len(sides), len(some)), np.uint8)
        wide[: len(sides)] = sides
        words = np.ascontiguousarray(wide.T).view(np.uint64)
        order = np.lexsort(words.T)
        words = words[order]
        first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1))))
        return bits[:, order[first]].T, some[order], first

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, top: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id) of `top` and of these documents; a mask is left aside only if its bound is below the k-th score."""
        at = np.searchsorted(self.codes, terms)
        at[at == len(self.codes)] = 0
        there = self.codes[at] == terms
        at, terms, weights = at[there], terms[there], weights[there]
        if not len(at):
            return top
        masks, docs, first = self.masks(at)
        least_m = np.minimum.reduceat(self.m[docs], first)
        limit = (masks * (weights * bound(self.most_tf[at][None, :], least_m[:, None]))).sum(axis=1)
        sizes = np.diff(np.append(first, len(docs)))
        order = np.argsort(-limit, kind="stable")
        done = 0
        while done < len(order) and (len(top) < k or limit[order[done]] >= -top[-1][0]):
            upto = done + max(1, int(np.searchsorted(np.cumsum(sizes[order[done:]]), 8 * k)))
            own = np.concatenate([docs[first[g] : first[g] + sizes[g]] for g in order[done:upto]])
            keys = (terms.astype(np.int64) * len(self.doc))[:, None] + own[None, :]
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            tf = np.where(self.keys[place] == keys, self.tf[place], 0)
            scores = (weights[:, None] * bound(tf, self.m[own][None, :])).sum(axis=0)
            top = sorted([*top, *((-s, d) for s, d in zip(scores.tolist(), self.doc[own].tolist(), strict=True) if s > 0)])[:k]
            done = upto
        return top


def _ranked(items: list[tuple[list[int], list[int]]], documents: int, total: int, k: int, shard_docs: int):
    """Blobs to rows (item, doc_id, score): the best of a task's documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(np.array(t, np.int32), np.array(w, np.int64)) for t, w in items]
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held: list[bytes] = []
        size = 0

        def judge() -> None:
            shard = Shard(held, documents, total)
            for i, (terms, weights) in enumerate(asked):
                best[i] = shard.best(terms, weights, k, best[i])
            held.clear()

        with lean_worker():
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    held.append(blob)
                    size += len(unpacked(blob, *_TYPES)[0])
                    if size >= shard_docs:
                        judge()
                        size = 0
            if held:
                judge()
            rows = [(i, d, -s) for i, top in enumerate(best) for s, d in top]
            if rows:
                item, doc, score = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(item, pa.int32()), pa.array([None if d == NULL_ID else d for d in doc], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, pairs: DataFrame, k: int, shard_docs: int) -> DataFrame:
    """The ranking for items of at most MOST_PAIRS pairs (item_id, term), which are brought to the driver and sent to every task."""
    spark = docs.sparkSession
    rows = pairs.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()
    codes = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
    found = checkpointed(docs.mapInArrow(_postings({t.encode(): i for t, i in codes.items()}), "blob binary, code int, n long"))
    counts = {r.code: r.n for r in found.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n")).collect()}  # a row for each asked term
    documents, total = counts.get(_N, 0), counts.get(_L, 0)
    weight = {c: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for c, df in counts.items() if c >= 0}
    own = [[c for t in r.terms if weight.get(c := codes[t], 0) > 0] for r in rows]
    items = [(c, [weight[x] for x in c]) for c in own]
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], pa_schema(pairs))
    blobs = found.filter("blob is not null").select("blob")
    best = blobs.mapInArrow(_ranked(items, documents, total, k, shard_docs), "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = best.withColumn("salt", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def pa_schema(pairs: DataFrame) -> str:
    return f"item int, item_id {pairs.schema['item_id'].dataType.simpleString()}"


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_docs: int = 8192, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 for each item, all if fewer.

    Scores are exact integers, as the module's `bound`, `lengths` and the weights floor(1000 ln((2N+2)/(2df+1))) give them; equal scores go by id, a null id
    last. Null and empty texts have no terms, so such documents and items have no rows. Rows of one item id ask together; rows that share
    a document id are documents of their own. Empty tables give no rows; other columns are ignored.

    One pass over the texts keeps of each document only its asked terms and counts N, the terms' total and every df, summed within a task.
    A second pass packs about `shard_docs` documents into bitmaps, one for each term; an item's bitmaps, turned, give the documents' masks. A mask's bound takes its terms' largest tf and
    its shortest document; masks are evaluated by descending bound until the next is below the k-th score, which a task carries from shard to shard.
    Tasks send k rows for each item. Items beyond `most_pairs` pairs of item and term are asked in blocks.
    """
    pairs = items.select(F.col(item_col).alias("item_id"), F.explode(terms_of(F.col(item_text).cast("string"))).alias("term")).distinct()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    blocks = -(-pairs.count() // most_pairs) or 1
    out = None
    for i in range(blocks):
        own = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        part = _block(base, own, k, shard_docs)
        out = part if out is None else out.unionByName(part)
    return out
