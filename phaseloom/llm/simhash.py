"""SimHash near-duplicates: fingerprints, and links by a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed, partitions
from phaseloom.llm.textscan import lean_worker, text_slices


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bits that over half of the shingles' XXH64 values have set; A-Z count as a-z, a text without words has 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    own = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[: len(starts) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 14):
        ones += np.unpackbits(own[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            for batch in batches:
                own = np.array([fingerprint(t, shingle) for *_, texts in text_slices(batch.column(1)) for t in texts], "<u8")
                yield pa.record_batch([batch.column(0), pa.array(own.view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence: neighbours there differ in few bits, and share high patterns."""
    out = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(by)
    return out


class GrayIndex:
    """Levels of groups over Gray-sorted codes. A group keeps the bits that all its members share, as a mask and a pattern.

    Each level joins `fan` neighbours of the one below. A node's own mask holds only the bits that its parent does not have
    already, so differences add up on the way down and no bit is compared twice.
    """

    def __init__(self, codes: np.ndarray, roots: np.ndarray, fan: int = 8):
        """codes: sorted by (root, Gray rank); roots: the root, from 0, of each code; groups never cross a root."""
        masks, patterns, spans = [np.full(len(codes), ~np.uint64(0))], [codes], [np.arange(len(codes) + 1)]
        root = roots
        while len(root) > root[-1] + 1:
            first = np.flatnonzero(np.diff(root, prepend=-1))
            place = np.arange(len(root)) - np.repeat(first, np.diff(np.append(first, len(root))))
            begins = np.flatnonzero(place % fan == 0)
            low, high = np.bitwise_and.reduceat(patterns[-1], begins), np.bitwise_or.reduceat(patterns[-1], begins)
            shared = np.bitwise_and.reduceat(masks[-1], begins) & ~(low ^ high)
            masks.append(shared)
            patterns.append(low & shared)
            spans.append(np.append(begins, len(root)))
            root = root[begins]
        self.masks, self.patterns, self.spans = masks[::-1], patterns[::-1], spans[::-1]  # from the roots down

    def pairs(self, most: int, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i < j) of codes under one root that differ in at most `most` bits.

        Pairs of groups go down the levels together, from each root paired with itself. `done` holds the bits that both sides
        shared above and the differences found there; a pair is dropped as soon as these exceed `most`.
        """
        n = len(self.masks[0])
        stack = [(0, np.arange(n), np.arange(n), np.zeros(n, np.uint64), np.zeros(n, np.int64))]
        while stack:
            level, a, b, done, gone = stack.pop()
            if len(a) > step:
                half = len(a) // 2
                stack += [(level, a[k], b[k], done[k], gone[k]) for k in (slice(half, None), slice(None, half))]
                continue
            both = self.masks[level][a] & self.masks[level][b]
            gone = gone + np.bitwise_count((self.patterns[level][a] ^ self.patterns[level][b]) & both & ~done)
            near = gone <= most
            a, b, gone, done = a[near], b[near], gone[near], (both | done)[near]
            if level == len(self.masks) - 1:
                apart = a != b
                if apart.any():
                    yield a[apart], b[apart]
                continue
            if not len(a):
                continue
            spans = self.spans[level]
            na, nb = spans[a + 1] - spans[a], spans[b + 1] - spans[b]
            total = na * nb
            if int(total.sum()) > 4 * step and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[k], b[k], np.zeros_like(done[k]), np.zeros_like(gone[k])) for k in (slice(half, None), slice(None, half))]
                continue
            at = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
            wide = np.repeat(nb, total)
            left, right = np.repeat(spans[a], total) + at // wide, np.repeat(spans[b], total) + at % wide
            use = (np.repeat(a, total) != np.repeat(b, total)) | (left <= right)
            stack.append((level + 1, left[use], right[use], np.repeat(done, total)[use], np.repeat(gone, total)[use]))


class Forest:
    """Union-find over numpy arrays; remembers the pairs that joined two trees."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs, those that a spanning forest needs beyond what earlier calls joined."""
        kept_a, kept_b = [], []
        while True:
            x, y = self.top[a], self.top[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]  # each tree joins one lower tree
            kept_a.append(a[first])
            kept_b.append(b[first])
            self.top[high[first]] = low[first]
            while True:
                up = self.top[self.top]
                if (up == self.top).all():
                    break
                self.top = up
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *kept_a]), np.concatenate([none, *kept_b])


def _segment(code: Column, k: int, segments: int) -> Column:
    low, high = 64 * k // segments, 64 * (k + 1) // segments
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def links(codes: DataFrame, most: int = 4) -> DataFrame:
    """a, b: links that connect exactly the distinct codes (column fp) of Hamming distance `most` or less.

    Two such codes agree in one of most + 1 segments of their bits, so each code goes to the bucket of each of its segments. A
    task sorts each bucket's codes by Gray rank, builds one index with a root for each bucket and keeps of the
    links it finds a spanning forest of each bucket: fewer links than codes, whatever a bucket holds. Codes must be distinct.
    """
    n = partitions(codes.sparkSession)
    segments = most + 1
    keys = F.array(*[_segment(F.col("fp"), k, segments) * segments + k for k in range(segments)])
    spread = codes.select("fp", F.explode(keys).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        code, bucket = np.concatenate([r[0] for r in rows]).view(np.uint64), np.concatenate([r[1] for r in rows])
        order = np.lexsort((gray_rank(code), bucket))
        code, bucket = code[order], bucket[order]
        roots = np.cumsum(np.diff(bucket, prepend=bucket[0]) != 0)
        forest = Forest(len(code))
        for a, b in GrayIndex(code, roots).pairs(most):
            a, b = forest.joined(a, b)
            if len(a):
                yield pa.record_batch([pa.array(code[x].view(np.int64)) for x in (a, b)], names=["a", "b"])

    found = spread.repartition(n, "bucket").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) of every node of the edges a, b.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to its least neighbour, then every
    node's smaller neighbours and itself are. Each round aggregates before it shuffles and is written to the checkpoint folder.
    """
    edges = checkpointed(edges.select("a", "b").filter("a <> b"))

    def both_ways(e: DataFrame) -> DataFrame:
        return e.union(e.select("b", "a")).toDF("a", "b")

    while True:
        two = both_ways(edges)
        least = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = two.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()
        new = checkpointed(small)
        same = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if same:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _members(docs: DataFrame, id_col: str, text_col: str, shingle: int, most: int) -> DataFrame:
    """doc_id, fp and c of every row: c is its component's first fingerprint, as (none, id, fp): the least id among its rows (none: it has no id), and itself."""
    own = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    # A fingerprint is a node of its own; its least id goes first, so that a component's least node names its least id. Fingerprints without any id come last.
    codes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    node = F.struct(F.col("least_id").isNull().alias("none"), F.coalesce("least_id", F.lit(0)).alias("id"), F.col("fp"))
    names = codes.select("fp", node.alias("node"))
    edges = links(codes.select("fp"), most)
    edges = edges.join(names.toDF("a", "from"), "a").join(names.toDF("b", "to"), "b").select(F.col("from").alias("a"), F.col("to").alias("b"))
    found = components(edges).select(F.col("node").alias("of"), F.col("component"))
    by_code = names.join(found, names["node"] == found["of"], "left").select("fp", F.coalesce("component", "node").alias("c"))
    return own.join(by_code, "fp").select("doc_id", "fp", "c")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the least id that links reach) of every row.

    Documents are linked if the SimHash of their word shingles differs in at most `most` of 64 bits. Null and empty texts have
    fingerprint 0 and are linked to one another. Copies are brought down to distinct fingerprints before the search, and come
    back by a join on the fingerprint. Rows are linked only through their fingerprints, never by an id that they share; null ids
    count only if a component has no other. An empty table gives no rows; other columns are ignored.
    """
    found = _members(docs, id_col, text_col, shingle, most)
    return found.select("doc_id", "fp", F.when(~F.col("c.none"), F.col("c.id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """One row of `docs` for each group of near-duplicates, with all its columns: one of the smallest id, and of these one of the group's first fingerprint.

    A group without any id keeps one row. Groups are of rows, so of rows that share an id each group that begins with it keeps one.

    Where every id is there once, ids alone decide and texts are not read again; rows without id and rows of repeated ids are told apart by their fingerprints.
    """
    found = checkpointed(_members(docs, id_col, text_col, shingle, most))
    first = F.col("fp").eqNullSafe(F.col("c.fp")) & F.when(F.col("c.none"), F.col("doc_id").isNull()).otherwise(F.col("doc_id").eqNullSafe(F.col("c.id")))
    own = docs[id_col].cast("long")
    later = found.filter(~first).filter("doc_id is not null").select(F.col("doc_id").alias("later_id"))
    again = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).count().filter("count > 1").select("again_id")
    if again.isEmpty() and found.filter("doc_id is null").isEmpty():
        return docs.join(later, own == later["later_id"], "left_anti")
    again = checkpointed(again)
    name = "fp"
    while name in docs.columns:
        name = f"_{name}"

    @F.pandas_udf("long")
    def code(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint((t or "").encode(), shingle) for t in texts], "<u8").view("<i8"))

    once = docs.filter(own.isNotNull()).join(again, own == again["again_id"], "left_anti")
    once = once.join(later, once[id_col].cast("long") == later["later_id"], "left_anti")
    odd = docs.filter(own.isNull()).unionByName(docs.join(again, own == again["again_id"], "left_semi")).withColumn(name, code(F.col(text_col).cast("string")))
    heads = found.filter(first).select(F.col("doc_id").alias("head_id"), F.col("fp").alias("head_fp")).distinct()
    odd = odd.join(heads, odd[id_col].cast("long").eqNullSafe(heads["head_id"]) & (odd[name] == heads["head_fp"]), "left_semi")
    return once.unionByName(odd.dropDuplicates([id_col, name]).drop(name))
