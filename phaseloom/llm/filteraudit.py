"""Filter interaction audit: a sparse document-term matrix decides filters over words; counts over all orders follow from the documents' failure masks."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed, partitions
from phaseloom.llm.textscan import lean_worker, packed, text_slices, unpacked

FILTERS = "ABCDE"
FLAGS = "doc long, part string, upper long, points long, marked boolean, digest binary"
_FLAGS = pa.struct([("doc", pa.int64()), ("part", pa.string()), ("upper", pa.int64()), ("points", pa.int64()), ("marked", pa.bool_()), ("digest", pa.binary())])
_SHARDS = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("piece", pa.int32()), ("blob", pa.binary()), ("docs", pa.list_(_FLAGS))])
_SHARDS_SQL = f"shard long, bucket int, piece int, blob binary, docs array<struct<{', '.join(x.replace(' ', ':') for x in FLAGS.split(', '))}>>"
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUED = bytes(range(128, 192))
#: Characters of which one alone fails filter D.
MARKS = b"#$%&*|"
_BUT_MARKS = bytes(b for b in range(256) if b not in MARKS)


class _Matrix:
    """CSR pieces of one shard, coded by the shard's own dictionary."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, texts: list[bytes], ids: pa.Array, parts: pa.Array) -> None:
        codes, width, indices, data = self.codes, [], [], []
        for text in texts:
            row = Counter(text.split())
            width.append(len(row))
            indices += [codes.setdefault(w, len(codes)) for w in row]
            data += row.values()
        self.size += sum(map(len, texts))
        flags = [
            ids, parts, pa.array([len(t.translate(None, _UPPER)) for t in texts], pa.int64()), pa.array([len(t.translate(None, _CONTINUED)) for t in texts], pa.int64()),
            pa.array([bool(t.translate(None, _BUT_MARKS)) for t in texts]), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
        ]
        self.pieces.append((np.array(width, "<i4"), np.array(indices, "<i4"), np.array(data, "<i4"), pa.StructArray.from_arrays(flags, fields=list(_FLAGS))))

    def rows(self, shard: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The shard's words by bucket, and its pieces coded in that order of words."""
        words = list(self.codes)
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), "<i4")
        place[order] = np.arange(len(order))
        bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        press = zstandard.ZstdCompressor(level=3).compress
        names = [int(bucket[order[x]]) for x in bounds[:-1]]
        blobs = [press(b" ".join([words[i] for i in order[x:y].tolist()])) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if names:
            yield pa.record_batch([pa.array([shard] * len(names), pa.int64()), pa.array(names, pa.int32()), pa.nulls(len(names), pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(names), pa.list_(_FLAGS))], schema=_SHARDS)
        for k, (width, indices, data, flags) in enumerate(self.pieces):
            own = place[indices] if len(indices) else indices
            docs = pa.ListArray.from_arrays(pa.array([0, len(flags)], pa.int32()), flags)
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.nulls(1, pa.int32()), pa.array([k], pa.int32()), pa.array([packed(1, width, own, data)]), docs], schema=_SHARDS)


def _shards(buckets: int, flush: int):
    """Documents to shards of about `flush` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, _Matrix()
        with lean_worker():
            for batch in batches:
                for i, j, texts in text_slices(batch.column(2)):
                    held.add(texts, batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))
                    if held.size >= flush:
                        yield from held.rows(shard, buckets)
                        shard, held = shard + 1, _Matrix()
            if held.pieces:
                yield from held.rows(shard, buckets)

    return run


def _numbered(buckets: int):
    """A bucket's words, in order of shards, to each shard's global codes: a word's place in its bucket, times the number of buckets, plus the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        own = None
        with lean_worker():
            for batch in batches:
                for shard, bucket, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if bucket != own:
                        codes, own = {}, bucket
                    words = zstandard.ZstdDecompressor().decompress(blob).split(b" ")
                    ids = np.array([codes.setdefault(w, len(codes)) for w in words], "<i8") * buckets + bucket
                    yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed(1, ids)])], names=["shard", "bucket", "blob"])

    return run


_CSR = pa.schema([("shard", pa.int64()), ("piece", pa.int32()), ("indptr", pa.list_(pa.int64())), ("indices", pa.list_(pa.int64())), ("data", pa.list_(pa.int32())), ("docs", pa.list_(_FLAGS))])
_COUNTED = pa.schema([*_FLAGS, ("n_words", pa.int64()), ("n_distinct", pa.int64())])


def _coded(counted: bool):
    """A shard's global codes by bucket, then its pieces: CSR pieces in global codes, or (`counted`) their rows' sums and numbers of non-zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, codes = None, [], None
        with lean_worker():
            for batch in batches:
                for k, (shard, piece, blob) in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True)):
                    if shard != own:
                        own, held, codes = shard, [], None
                    if piece is None:
                        held.append(unpacked(blob, "<i8")[0])
                        continue
                    if codes is None:
                        codes = np.concatenate([np.zeros(0, np.int64), *held])
                    width, indices, data = unpacked(blob, "<i4", "<i4", "<i4")
                    indptr, indices = np.concatenate(([0], np.cumsum(width, dtype=np.int64))), codes[indices]
                    docs = batch.column(4).slice(k, 1)
                    if counted:
                        sums = np.diff(np.concatenate(([0], np.cumsum(data, dtype=np.int64)))[indptr])
                        yield pa.record_batch([*docs.flatten().flatten(), pa.array(sums), pa.array(np.diff(indptr))], schema=_COUNTED)
                    else:
                        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([piece], pa.int32()), pa.array([indptr]), pa.array([indices], pa.list_(pa.int64())), pa.array([data], pa.list_(pa.int32())), docs], schema=_CSR)

    return run


def _matrix(docs: DataFrame, id_col: str, text_col: str, part_col: str, buckets: int | None, flush: int) -> tuple[DataFrame, int]:
    """Shards' pieces next to the global codes of their words, by shard."""
    n = buckets or 2 * partitions(docs.sparkSession)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), part.alias("part"), F.col(text_col).cast("string").alias("t"))
    cut = checkpointed(base.mapInArrow(_shards(n, flush), _SHARDS_SQL))
    words = cut.filter("piece is null").select("shard", "bucket", "blob").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "shard")
    codes = words.mapInArrow(_numbered(n), "shard long, bucket int, blob binary")
    both = codes.select("shard", "bucket", F.lit(None).cast("int").alias("piece"), "blob", F.lit(None).cast(cut.schema["docs"].dataType).alias("docs"))
    both = both.unionByName(cut.filter("piece is not null"))
    return both.repartition(n, "shard").sortWithinPartitions("shard", F.asc_nulls_first("piece"), "bucket"), n


def term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", buckets: int | None = None, flush_bytes: int = 16 << 20) -> DataFrame:
    """The sparse document-term matrix in CSR pieces: shard, piece, indptr, indices (global word codes), data (counts), docs (what is known of each row).

    Words are maximal runs of anything but ASCII white space. A task cuts its documents into shards of about `flush_bytes` of text and codes their words by a
    dictionary of the shard; each shard's distinct words go once to the bucket of their crc32, where words get their global codes, which
    go back. Words come in order of shards, so a repeated task gives the same codes. Documents without words are empty rows; an empty table gives no rows.
    """
    both, _ = _matrix(docs, id_col, text_col, part_col, buckets, flush_bytes)
    inner = _SHARDS_SQL.partition("docs ")[2]
    return both.mapInArrow(_coded(False), f"shard long, piece int, indptr array<long>, indices array<long>, data array<int>, docs {inner}")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", buckets: int | None = None, flush_bytes: int = 16 << 20) -> DataFrame:
    """doc, part, digest, n_words, n_distinct and the filters a, b, c, d that each document fails, from the rows of `term_matrix`.

    a: under 200 words (row sum); b: fewer than half of its words distinct (non-zeros); c: over 2 % A-Z; d: any of #$%&*|. A null text is an
    empty one, a null source the part ''; every row of the table has one row.
    """
    both, _ = _matrix(docs, id_col, text_col, part_col, buckets, flush_bytes)
    rows = both.mapInArrow(_coded(True), f"{FLAGS}, n_words long, n_distinct long")
    return rows.select(
        "doc", "part", "digest", "n_words", "n_distinct",
        (F.col("n_words") < 200).alias("a"), (100 * F.col("n_distinct") < 50 * F.col("n_words")).alias("b"),
        (100 * F.col("upper") > 2 * F.col("points")).alias("c"), F.col("marked").alias("d"),
    )


def masks(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: filter i fails), good, toxic, n: how many documents, with filter E (an equal text has a smaller id) added.

    A document's label is the largest of the rows with its id; without one, or without an id, it is neither good nor toxic. A row without id fails E
    never and makes none fail. A text's rows are first counted by id, then by text, so that a text of very many copies is a few rows.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    bits = F.col("a").cast("int") + 2 * F.col("b").cast("int") + 4 * F.col("c").cast("int") + 8 * F.col("d").cast("int")
    each = failing.select("doc", "part", "digest", bits.alias("mask")).join(known, "doc", "left").na.fill(False, ["good", "toxic"])
    by_id = each.groupBy("doc", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "n")))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc").isNull(), F.col("n"))).alias("no_id"))
    cells = by_text.groupBy("digest").agg(F.min("first.doc").alias("least"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "first", "no_id")).alias("cells"))
    cell = cells.select("least", F.explode("cells").alias("c")).select("least", "c.*")
    own = F.when(F.col("first.doc") == F.col("least"), F.col("first.n")).otherwise(F.lit(0)) + F.coalesce("no_id", F.lit(0))
    sides = F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n")))
    return cell.select("part", "good", "toxic", F.explode(sides).alias("s")).groupBy("part", F.col("s.mask").alias("mask"), "good", "toxic").agg(F.sum("s.n").alias("n"))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    What a step does depends on its filter and on the set of earlier ones only, so each cell is counted once for each such pair, and the orders
    look their steps up. `shapley` weighs each set by the number of orders that have it.
    """
    n, spark = len(filters), cells.sparkSession
    sets = [(i, s) for i in range(n) for s in range(1 << n) if not s >> i & 1]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("filter"), F.lit(s).alias("before")) for i, s in sets])).alias("p")
    each = cells.select("part", "mask", "good", "toxic", "n", pairs).select("*", "p.*")
    fails = F.expr("shiftright(mask, filter) & 1") == 1
    alive = F.expr("mask & before") == 0

    def total(condition) -> F.Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    steps = each.groupBy("part", "filter", "before").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.expr("mask = shiftleft(1, filter)")).alias("unique_fails"), total(alive & fails & F.col("good")).alias("good_lost"), total(alive & fails & F.col("toxic")).alias("toxic_lost"),
    )
    orders = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            orders.append(("".join(filters[j] for j in order), step, i, before, math.factorial(step - 1) * math.factorial(n - step)))
            before |= 1 << i
    named = spark.createDataFrame(orders, "filter_order string, step int, filter int, before int, orders long")
    weights = named.select("filter", "before", "orders").distinct()
    value = steps.join(F.broadcast(weights), ["filter", "before"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    out = steps.join(value, ["part", "filter"]).join(F.broadcast(named), ["filter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, buckets: int | None = None, flush_bytes: int = 16 << 20) -> DataFrame:
    """`interactions` of the five filters over all documents; an empty table gives no rows, other columns are ignored."""
    return interactions(checkpointed(masks(failures(docs, buckets=buckets, flush_bytes=flush_bytes), labels)))
