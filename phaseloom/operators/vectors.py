"""Vectors: standardising, cosine search in blocks, agreement of neighbours, quality checks, linear models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def consecutive_distance(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Adds step: the distance to the row before within its group; null for the first."""
    return rows.withColumn("step", distance(F.col(vector), F.lag(vector).over(W.partitionBy(group).orderBy(order))))


def dimension_stats(rows: DataFrame, vector: str) -> DataFrame:
    """dim (from 0), mean, std (population) over all rows: one row for each dimension."""
    return rows.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def standardised(rows: DataFrame, vector: str) -> DataFrame:
    """The vector minus the mean over the population deviation, dimension by dimension; without deviation the scale is 1."""
    stats = dimension_stats(rows, vector).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    scaled = F.zip_with(F.col(vector), F.col("_s"), lambda x, s: (x.cast("double") - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0))
    return rows.join(F.broadcast(stats)).withColumn(vector, scaled).drop("_s")


def _packed(rows: DataFrame, id_col: str, vector: str, block: int, tags: list[str] = ()) -> DataFrame:
    """ids and unit vectors of up to `block` rows of a task as two strings of bytes (8-byte integers, doubles), and their tags, column by column; null, empty and zero vectors take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                labels = pa.array([[part.column(2 + c).to_pylist() for c in range(len(tags))]], pa.list_(pa.list_(pa.string())))
                yield pa.record_batch([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary()), labels], names=["ids", "vectors", "tags"])

    named = [F.col(c).cast("string").alias(f"_tag{k}") for k, c in enumerate(tags)]
    own = rows.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>"), *named).filter((F.size(vector) > 0) & (norm(F.col(vector)) > 0) & F.col(id_col).isNotNull())
    return own.mapInArrow(run, "ids binary, vectors binary, tags array<array<string>>")


def _best(bounds: tuple[int, bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, skip_self = bounds

    def matrix(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
        names = np.frombuffer(ids, np.int64)
        return names, np.frombuffer(vectors, float).reshape(len(names), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, []
        for batch in batches:
            for place, kind, ids, vectors, tags in zip(*(batch.column(c).to_pylist() for c in range(5))):
                names, x = matrix(ids, vectors)
                if place != held:
                    held, mine = place, []
                if kind == 0:
                    mine.append((names, x, tags))
                    continue
                for own, rows, have in mine:
                    score = x @ rows.T
                    for asked, given in zip(tags, have, strict=True):
                        score[~_allowed(asked, given)] = -np.inf
                    if skip_self:
                        score[names[:, None] == own[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(own, score.shape), -score))[:, :k]
                    score, who = np.take_along_axis(score, order, 1), own[order]
                    keep = np.isfinite(score)
                    yield pa.record_batch([pa.array(np.repeat(names, keep.sum(axis=1))), pa.array(who[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    return run


def _allowed(asked: list[str | None], given: list[str | None]) -> np.ndarray:
    """Queries x rows: whether a row has the query's tag; a query without tag takes every row."""
    codes = {tag: n for n, tag in enumerate(dict.fromkeys(given))}
    want = np.array([-1 if tag is None else codes.get(tag, -2) for tag in asked])
    return (want[:, None] == -1) | (want[:, None] == np.array([-3 if tag is None else codes[tag] for tag in given])[None, :])


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 2048, places: int | None = None, skip_self: bool = True, match: dict[str, str] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: exact k nearest rows by cosine for a stated set of queries, ties to the smaller id.

    Rows are packed in blocks, which are dealt to `places` (as many as there are shuffle partitions, if not told); the queries'
    blocks go to each place. A task holds the rows of its place, meets one block of queries after another in products of matrices,
    and passes on k rows for each query and block. Nothing goes through the driver. Vectors must have one length; null and zero
    vectors and rows without id take no part; rows that share an id are rows of their own. A place holds its share of the rows'
    vectors, so `places` should grow with the rows.

    `match` names columns of rows and the queries' columns that they must equal, as strings: a row that differs is struck from the block's
    scores before its k best are taken, so a rare tag loses no neighbour. A null in a query's column allows every row; a row's null equals nothing.
    """
    match = match or {}
    places = places or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _packed(rows, id_col, vector, block, list(match)).select((F.pmod(F.xxhash64("ids"), F.lit(places))).cast("int").alias("place"), F.lit(0).alias("kind"), "ids", "vectors", "tags")
    asked = _packed(queries, id_col, vector, block, list(match.values())).select(F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"), F.lit(1).alias("kind"), "ids", "vectors", "tags")
    met = dealt.unionByName(asked).repartition(places, "place").sortWithinPartitions("place", "kind")
    found = met.mapInArrow(_best((k, skip_self)), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbour_agreement(nearest: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n_queries, agreement: the mean share of a query's neighbours that have its label; labels are (vec_id, label)."""
    own = nearest.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "own"}), "query_id").join(labels, "vec_id")
    each = own.groupBy("query_id", "own").agg(F.avg((F.col("label") == F.col("own")).cast("double")).alias("share"))
    return each.groupBy(F.col("own").alias("label")).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("share").alias("agreement"))


def quality_checks(rows: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """check, n_bad, passed: not-a-number, infinite, zero, wrong length, duplicate vectors, duplicate ids, and dimensions without spread."""
    x = F.col(vector)
    facts = rows.agg(
        F.count_if(F.exists(x, lambda v: F.isnan(v))).alias("nan"), F.count_if(F.exists(x, lambda v: F.abs(v) == float("inf"))).alias("infinite"),
        F.count_if(F.forall(x, lambda v: v == 0)).alias("zero"), F.count_if(F.size(x) != dims).alias("wrong_length"), F.count(F.lit(1)).alias("n"),
    )
    same = rows.groupBy(vector).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_vectors"))
    ids = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_ids"))
    dead = dimension_stats(rows, vector).agg(F.count_if(F.col("std") < 1e-8).alias("dead_dimensions"))
    one = facts.join(F.broadcast(same)).join(F.broadcast(ids)).join(F.broadcast(dead))
    names = ["nan", "infinite", "zero", "wrong_length", "duplicate_vectors", "duplicate_ids", "dead_dimensions"]
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n_bad")) for c in names]))
    return one.select(parts.alias("x")).select("x.*").withColumn("passed", (F.col("n_bad") == 0).cast("long"))


def nearest_centroid(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """id columns kept, actual and predicted: the label whose mean vector is nearest (ties: smaller label). Labels are few."""
    means = rows.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy(F.col(label).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("v"))
    table = centres.agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("_t"))
    best = F.array_min(F.transform(F.col("_t"), lambda t: F.struct(F.round(distance(F.col(vector), t["v"]), 12).alias("d"), t["c"].alias("c"))))
    return rows.join(F.broadcast(table)).withColumn("predicted", best["c"]).withColumn("actual", F.col(label)).drop("_t")


def cluster_agreement(pairs: DataFrame) -> DataFrame:
    """ari and nmi of (label, cluster) rows, from their contingency table; null where undefined."""
    cells = pairs.groupBy("label", "cluster").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cells.groupBy("label").agg(F.sum("n").alias("a")), cells.groupBy("cluster").agg(F.sum("n").alias("b"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    total = cells.agg(F.sum("n").alias("t"), F.sum(two("n")).alias("s"))
    ra = rows.join(F.broadcast(total)).agg(F.sum(two("a")).alias("sa"), F.sum(-F.col("a") / F.col("t") * F.ln(F.col("a") / F.col("t"))).alias("ha"))
    cb = cols.join(F.broadcast(total)).agg(F.sum(two("b")).alias("sb"), F.sum(-F.col("b") / F.col("t") * F.ln(F.col("b") / F.col("t"))).alias("hb"))
    mi = cells.join(rows, "label").join(cols, "cluster").join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    one = total.join(F.broadcast(ra)).join(F.broadcast(cb)).join(F.broadcast(mi))
    chance = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2 - chance
    return one.select(F.when(top != 0, (F.col("s") - chance) / top).alias("ari"), F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def cumulative_variance(rows: DataFrame, vector: str) -> DataFrame:
    """component, share, cumulative of the principal components: the covariance is summed on the executors, its size is dims squared."""
    stats = rows.select(F.col(vector).alias("v")).mapInArrow(_moments, "n double, s array<double>, ss array<double>").toPandas()
    if not len(stats) or not stats["n"].sum():
        return rows.sparkSession.createDataFrame([], "component long, share double, cumulative double")
    n, s = stats["n"].sum(), np.sum(np.array(stats["s"].tolist()), axis=0)
    values = np.linalg.eigvalsh(np.sum(np.array(stats["ss"].tolist()), axis=0).reshape(len(s), len(s)) / n - np.outer(s / n, s / n))[::-1]
    share = np.maximum(values, 0) / max(np.maximum(values, 0).sum(), 1e-300)
    return rows.sparkSession.createDataFrame([(k, float(x), float(c)) for k, (x, c) in enumerate(zip(share, np.cumsum(share), strict=True))], "component long, share double, cumulative double")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: count, sum and sum of outer products of its vectors."""
    n, s, ss = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
    if n:
        yield pa.record_batch([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])


def principal_axes(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean vector and the k axes (k x dims) of most variance, of each axis the largest component positive; sums are made on the executors, what comes here is dims squared.

    Null vectors take no part. Without vectors, or with fewer dimensions than k, it is an error.
    """
    stats = rows.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).mapInArrow(_moments, "n double, s array<double>, ss array<double>")
    place = F.posexplode(F.concat("s", "ss")).alias("at", "x")
    n = stats.agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError("no vectors to take axes from")
    sums = np.array([r["x"] for r in stats.select(place).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()])  # dims + dims squared numbers
    dims = round((-1 + (1 + 4 * len(sums)) ** 0.5) / 2)
    if k > dims:
        raise ValueError(f"{k} axes of {dims} dimensions")
    mean = sums[:dims] / n
    _, found = np.linalg.eigh(sums[dims:].reshape(dims, dims) / n - np.outer(mean, mean))
    axes = found[:, ::-1][:, :k].T
    return mean, axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], 1) < 0, -1, 1)


def _by_matrix(v: Column, matrix: np.ndarray, shift: np.ndarray) -> Column:
    """matrix @ (v - shift), a batch of vectors in one product; null for null and for vectors of another length."""

    def run(batch: pa.Array) -> pa.Array:
        known = np.array([x is not None and len(x) == len(shift) for x in batch.to_pylist()], bool)
        flat = batch.filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(shift))
        out = iter(((flat - shift) @ matrix.T).tolist())
        return pa.array([next(out) if ok else None for ok in known], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(v.cast("array<double>"))


def projected(rows: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, name: str = "projection") -> DataFrame:
    """Adds the coordinates of the centred vector on the axes; null without a vector."""
    return rows.withColumn(name, _by_matrix(F.col(vector), axes, mean))


def reconstruction(rows: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """n, mse (of a component) and explained (share of the spread around the mean) when vectors are rebuilt from their coordinates: the squared length that the axes do not hold."""
    centre = F.array(*[F.lit(float(x)) for x in mean])
    both = projected(rows, vector, mean, axes, "_p").select(F.pow(distance(F.col(vector), centre), F.lit(2)).alias("spread"), dot(F.col("_p"), F.col("_p")).alias("held"))
    return both.agg(F.count("held").alias("n"), (F.avg(F.col("spread") - F.col("held")) / len(mean)).alias("mse"), (F.sum("held") / F.nullif(F.sum("spread"), F.lit(0.0))).alias("explained"))


def linear_dynamics(rows: DataFrame, group: str, order: str, vector: str, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """A and b of x' = A x + b by ridge regression of each row on the row before: Gram matrices are summed on the executors and solved here."""
    pairs = rows.select(F.col(vector).alias("y"), F.lag(vector).over(W.partitionBy(group).orderBy(order)).alias("x")).filter("x is not null")
    both = pairs.select(F.concat(F.col("x"), F.col("y")).alias("v")).mapInArrow(_moments, "n double, s array<double>, ss array<double>").toPandas()
    n, s = both["n"].sum(), np.sum(np.array(both["s"].tolist()), axis=0)
    ss = np.sum(np.array(both["ss"].tolist()), axis=0).reshape(len(s), len(s))
    d = len(s) // 2
    mx, my = s[:d] / n, s[d:] / n
    xx, xy = ss[:d, :d] - n * np.outer(mx, mx), ss[:d, d:] - n * np.outer(mx, my)
    a = np.linalg.solve(xx + ridge * np.eye(d), xy).T
    return a, my - a @ mx


def forecast_errors(rows: DataFrame, group: str, order: str, vector: str, a: np.ndarray, b: np.ndarray, horizons: list[int]) -> DataFrame:
    """horizon, n, mse, naive_mse: forecasts k rows ahead by repeating the dynamics, against keeping the vector as it is."""
    out = None
    for k in horizons:
        power, shift = np.linalg.matrix_power(a, k), sum((np.linalg.matrix_power(a, i) @ b for i in range(k)), np.zeros(len(b)))
        table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in power])
        moved = F.transform(table, lambda row: dot(row, F.col(vector)))
        ahead = F.zip_with(moved, F.array(*[F.lit(float(x)) for x in shift]), lambda x, y: x + y)
        pairs = rows.select(ahead.alias("p"), F.col(vector).alias("x"), F.lead(vector, k).over(W.partitionBy(group).orderBy(order)).alias("y")).filter("y is not null")
        one = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(distance(F.col("p"), F.col("y")), F.lit(2)) / len(b)).alias("mse"), F.avg(F.pow(distance(F.col("x"), F.col("y")), F.lit(2)) / len(b)).alias("naive_mse"))
        one = one.select(F.lit(k).cast("long").alias("horizon"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """Adds cluster, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("_f").withColumn("cluster", F.col("cluster").cast("long"))


def logistic_scores(rows: DataFrame, features: list[str], label: str, c: float = 1.0) -> DataFrame:
    """Adds prob: logistic regression with an L2 penalty of 1 / (c * n) on unscaled features, intercept free."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=features, outputCol="_f").transform(rows)
    n = ready.count()
    model = LogisticRegression(featuresCol="_f", labelCol=label, regParam=1.0 / (c * max(n, 1)), standardization=False, predictionCol="_y", rawPredictionCol="_r", probabilityCol="_p").fit(ready)
    return model.transform(ready).withColumn("prob", vector_to_array("_p")[1]).drop("_f", "_y", "_r", "_p")
