"""Approximate nearest neighbours by inner product: adaptive dimension scans over rotated vectors in inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed, partitions

#: Hypothesis tests give up on a candidate if its partial distance is this many standard deviations too large.
CONFIDENCE = 2.1


@dataclass(frozen=True)
class Index:
    """Everything tasks need: list centres and the rotation, for vectors lengthened by one component to a common norm."""

    centres: np.ndarray
    rotation: np.ndarray
    norm2: float
    probes: int
    blocks: tuple[int, ...]

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """Vectors whose nearest by distance to a query (lengthened by 0) are the query's largest inner products."""
        return np.hstack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))[:, None]])

    def nearest_lists(self, x: np.ndarray, count: int) -> np.ndarray:
        far = (self.centres * self.centres).sum(axis=1)[None, :] - 2 * (x @ self.centres.T)
        if count >= far.shape[1]:
            return np.argsort(far, axis=1)
        return np.argpartition(far, count - 1, axis=1)[:, :count]


def usable(vector: Column, dims: int) -> Column:
    """Not null, of `dims` components, all of them finite and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def fit_index(vectors: DataFrame, list_size: int = 4096, probe_share: float = 0.7, most_lists: int = 4096, sample: int = 16384, seed: int = 7) -> Index | None:
    """An index over `vectors` (vec_id, vector), fitted on at most `sample` of them, the first by a hash of the id.

    The number of lists follows the number of vectors, `list_size` to a list, up to `most_lists`; `probe_share` of them are
    searched for each query. Centres come from k-means on the sample. None if there are no vectors.
    """
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm2")).first()
    if not facts["n"]:
        return None
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"]
    x = np.array(rows.tolist(), np.float64)
    rng = np.random.default_rng(seed)
    lists = min(max(1, -(-facts["n"] // list_size)), most_lists, len(x))
    plain = Index(np.zeros((1, 1)), np.eye(1), float(facts["norm2"]), 1, ())
    long_ = plain.lengthened(x)
    centres = long_[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        own = np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * (long_ @ centres.T), axis=1)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, long_)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    dims = long_.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    edges = sorted({min(dims, max(1, round(dims * share))) for share in (0.25, 0.5, 0.75, 1)})
    return Index(centres, rotation, float(facts["norm2"]), max(1, math.ceil(probe_share * lists)), tuple(edges))


def scan(index: Index, rows: np.ndarray, queries: np.ndarray, k: int, block: int = 1024) -> list[np.ndarray]:
    """Positions of the k rows nearest to each query among those that no test abandoned (rotated, lengthened vectors).

    Rows come in blocks, each stored by groups of columns. After every group of columns, a candidate is abandoned if its
    partial distance, scaled to all dimensions, is significantly above the query's k-th best so far. While
    most candidates live, a group is one product of matrices; once few do, only their own components are read.
    """
    dims, n, m = rows.shape[1], len(rows), len(queries)
    best = np.full((m, 0), np.inf)
    place = np.zeros((m, 0), np.int64)
    for low in range(0, n, block):
        part = rows[low : low + block]
        bound = best[:, k - 1] if best.shape[1] >= k else np.full(m, np.inf)
        dist = np.zeros((m, len(part)))
        alive = np.ones(dist.shape, bool)
        begin = 0
        for end in index.blocks:
            q, x = queries[:, begin:end], part[:, begin:end]
            live = int(alive.sum())
            if live * 8 < alive.size:
                a, b = np.nonzero(alive)
                dist[a, b] += ((q[a] - x[b]) ** 2).sum(axis=1)
            else:
                dist += (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
            slack = (1 + CONFIDENCE / math.sqrt(end)) ** 2 if end < dims else 1.0
            alive &= dist * (dims / end) <= (bound * slack)[:, None]
            begin = end
        dist[~alive] = np.inf
        best = np.hstack([best, dist])
        place = np.hstack([place, np.broadcast_to(np.arange(low, low + len(part)), dist.shape)])
        if best.shape[1] > k:
            near = np.argpartition(best, k - 1, axis=1)[:, :k]
            best, place = np.take_along_axis(best, near, 1), np.take_along_axis(place, near, 1)
            order = np.argsort(best, axis=1)
            best, place = np.take_along_axis(best, order, 1), np.take_along_axis(place, order, 1)
    return [p[np.isfinite(d)] for p, d in zip(place, best, strict=True)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None, probe_share: float = 0.7, chunk: int = 4096, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k candidates of largest inner product that were found.

    Candidates are all rows of `vectors` but those of the query's own id; score is the inner product of the original vectors in
    double precision, ties go to the smaller id. Vectors that are null, zero, of another length than `dims` (the most
    frequent one by default) or hold null or non-finite components take no part, nor do rows without id; repeated rows count once. Fewer
    candidates than k give all that there are; empty tables give no rows. Other columns are ignored.

    Equal vectors are searched once: of the candidates the k + 1 smallest ids are kept, as no other can be among the nearest,
    and queries with equal vectors share one search. Vectors go to the list of their nearest centre; lists of more than about `chunk`
    vectors are dealt in several parts. Each part meets the queries that probe its list in one task, which holds the part and streams the
    queries. The index is fitted on a bounded sample (see fit_index), every vector is indexed.
    """
    spark = vectors.sparkSession
    sane = [df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(F.col("vec_id").isNotNull()) for df in (vectors, queries)]
    if dims is None:
        found = sane[0].groupBy(F.size("vector").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").limit(1).collect()
        dims = found[0]["n"] if found else 0
    rows, asked = (df.filter(usable(F.col("vector"), dims)).distinct() for df in sane)
    few = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    rows = checkpointed(rows.withColumn("n", few).filter(F.col("n") <= k + 1).drop("n"))
    index = index or fit_index(rows, probe_share=probe_share)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    schema = f"vec_id long, vector {dict(rows.dtypes)['vector']}, list int"

    def placed(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                x = _matrix(batch.column(1))
                x = own.lengthened(x) if count == 1 else np.hstack([x, np.zeros((len(x), 1))])
                lists = own.nearest_lists(x, count)
                row = np.repeat(np.arange(len(x)), lists.shape[1])
                yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(lists.ravel().astype(np.int32))], names=["vec_id", "vector", "list"])

        return run

    stored = checkpointed(rows.mapInArrow(placed(1), schema))
    parts = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))  # at most one row for each list
    stored = stored.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    shared_search = checkpointed(asked.groupBy("vector").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "vector"))
    probing = shared_search.mapInArrow(placed(index.probes), schema).join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["list", "part", "kind", "vec_id", "vector"]
    both = stored.withColumn("kind", F.lit(0)).select(columns).unionByName(probing.withColumn("kind", F.lit(1)).select(columns))
    both = both.repartition(partitions(spark), "list", "part").sortWithinPartitions("list", "part", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cell, ids, plain, turned = None, [], [], None
        for batch in batches:
            lists, part, kind = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.diff(lists, prepend=-1).astype(bool) | np.diff(part, prepend=-1).astype(bool) | np.diff(kind, prepend=-1).astype(bool))
            for low, high in zip(edges, np.append(edges[1:], len(lists)), strict=True):
                piece = batch.slice(low, high - low)
                if (lists[low], part[low]) != cell:
                    cell, ids, plain, turned = (lists[low], part[low]), [], [], None
                x = _matrix(piece.column(4))
                if kind[low] == 0:
                    ids.append(piece.column(3).to_numpy())
                    plain.append(x)
                    continue
                if turned is None:
                    if not ids:
                        continue
                    ids, plain = np.concatenate(ids), np.concatenate(plain)
                    turned = own.lengthened(plain) @ own.rotation
                names = piece.column(3).to_numpy()
                for at in range(0, len(x), 256):
                    some = x[at : at + 256]
                    near = scan(own, turned, np.hstack([some, np.zeros((len(some), 1))]) @ own.rotation, k + 1)
                    sizes = [len(p) for p in near]
                    q, p = np.repeat(np.arange(len(some)), sizes), np.concatenate(near)
                    score = np.einsum("ij,ij->i", some[q], plain[p])
                    entries = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids[p])], ["far", "vec_id"])
                    lists_ = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), entries)
                    group = pa.array(np.full(len(some), (cell[0] * 31 + cell[1]) % groups), pa.int32())
                    yield pa.record_batch([pa.array(names[at : at + 256]), group, lists_], names=["query", "part", "found"])

    # The nearest of a query's parts are merged in two steps, each over about the root of their number.
    cells = index.probes * (parts.agg(F.max("parts")).first()[0] or 1)
    groups = math.ceil(math.sqrt(cells))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")
    found = both.mapInArrow(answer, "query long, part int, found array<struct<far:double,vec_id:long>>")
    found = found.groupBy("query", "part").agg(best).groupBy("query").agg(best)
    found = found.select("query", F.explode("found").alias("x")).select("query", "x.vec_id", (-F.col("x.far")).alias("score"))
    alike = asked.join(shared_search.withColumnRenamed("vec_id", "query"), "vector").select("query", F.col("vec_id").alias("query_id"))
    out = alike.join(found, "query").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
