"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed, word_count

#: A Pareto rank is found within one of so many bins of a source; only the bin totals are summed over a source.
BINS = 4096
#: Tables of one row for each source are broadcast up to so many rows.
MOST_BROADCAST = 100_000
#: Importances are whole numbers from 1 up to this.
MOST_IMPORTANT = 1024


def digits_of(size: Column) -> Column:
    """Binary digits of a size: an importance by which a document of a thousand words is asked for 2.5 times as often as one of ten."""
    return F.length(F.bin(size))


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the key alone: the first 48 bits of an MD5, shifted off both ends."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3) -> DataFrame:
    """source, source_size, target, n_docs: one row for each source of (source, size).

    Sources by code point, the null source last, get the weights in turn and share the total size by weight. A target stops at
    `most_copies` times its source's size; what it leaves is shared by weight again until none is above. The water level at which
    a source stops is compared in whole numbers, so the result does not depend on rounding.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights)))).cast("long"))
    whole = W.partitionBy()
    level = F.col("source_size") * most_copies / F.col("weight")
    rise = W.orderBy("level", "place").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("level", level).withColumn("place", place).withColumn("total", F.sum("source_size").over(whole))
    per = per.withColumn("below", F.sum("source_size").over(rise) * most_copies)
    per = per.withColumn("weight_above", F.sum("weight").over(whole) - F.sum("weight").over(rise))
    # A source stops if the total would not be reached with the water at its own level.
    per = per.withColumn("stops", F.col("below") * F.col("weight") + most_copies * F.col("source_size") * F.col("weight_above") <= F.col("total") * F.col("weight"))
    stopped = F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size") * most_copies)).over(whole), F.lit(0))
    open_ = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(whole)
    shared = F.col("weight") * (F.col("total") - stopped).cast("double") / open_
    full = (F.col("source_size") * most_copies).cast("double")
    return per.select("source", "source_size", F.when(F.col("stops"), full).otherwise(F.least(shared, full)).alias("target"), "n_docs")


def _plan(rows: DataFrame, weights: tuple[int, ...], most_copies: int) -> DataFrame:
    """For each source of (source, size, weight): target, source_size, full_from and per_weight.

    A document is expected `weight` times `per_weight` times; documents of a weight of `full_from` or more would pass `most_copies`
    then, so they get just these, and `per_weight` is what the others need to reach the target. Weights are whole numbers of a
    bounded range, so the classes that are sorted for a source are few; all sums are of whole numbers.
    """
    classes = rows.groupBy("source", "weight").agg(F.sum("size").alias("s"))
    down = W.partitionBy("own_source").orderBy(F.desc("weight")).rowsBetween(W.unboundedPreceding, 0)
    own = W.partitionBy("own_source")
    classes = classes.join(source_targets(rows, weights, most_copies).withColumnRenamed("source", "own_source"), F.col("source").eqNullSafe(F.col("own_source"))).drop("source")
    above, weighed = F.sum("s").over(down), F.sum(F.col("s") * F.col("weight"))
    full = most_copies * (F.col("weight") * above + weighed.over(own) - weighed.over(down)) <= F.col("target") * F.col("weight")
    classes = classes.withColumn("full", full)
    sure = F.coalesce(F.sum(F.when(F.col("full"), most_copies * F.col("s"))), F.lit(0))
    shared = F.sum(F.when(~F.col("full"), F.col("s") * F.col("weight")))
    per = classes.groupBy("own_source", "source_size", "target", "n_docs").agg(F.min(F.when(F.col("full"), F.col("weight"))).alias("full_from"), F.when(shared > 0, (F.col("target") - sure) / shared).otherwise(0.0).alias("per_weight"))
    return per.withColumnRenamed("own_source", "source")


def _with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows joined with the one row of their source; sent to all tasks if there are few sources, else shuffled."""
    few = per.count() <= MOST_BROADCAST
    per = per.withColumnRenamed("source", "own_source")
    return rows.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")


def _ranked(rows: DataFrame, most_copies: int, salt: str) -> DataFrame:
    """Adds whole (copies for sure), rank (of the Pareto order, mapped to (0, 1); null if no further copy is allowed) and bin."""
    most = F.lit(float(most_copies))
    full = (F.col("source_size") > 0) & F.coalesce(F.col("weight") >= F.col("full_from"), F.lit(False))
    rows = rows.withColumn("expected", F.when(full, most).otherwise(F.least(F.col("weight") * F.col("per_weight"), most))).withColumn("whole", F.floor("expected"))

    def odds(p: Column) -> Column:
        p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return p / (1 - p)

    u = uniform(F.concat_ws(":", F.col("doc_id"), F.col("size")), salt)
    order = (u / (1 - u)) / odds(F.col("expected") - F.col("whole"))
    rank = F.when(F.col("whole") < most_copies, order / (1 + order))
    return rows.withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") * BINS))


def _place() -> Column:
    return F.struct("rank", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "size")


def _after(cut: Column) -> Column:
    """Whether a row comes after the last row that its source takes in order."""
    return (F.col("bin") > F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(_place() > cut, F.lit(True)))


def _cuts(rows: DataFrame) -> DataFrame:
    """For each source: cut_bin, last (rank, doc_id, size) of the last row taken in order, and closing, one more row that fills the gap.

    Bins that end below what is left of the target are taken whole; the rows of the one bin that holds the end are sorted, and
    taken as long as they fit. Of the rows after them, the one whose size is nearest to the gap closes it.
    """
    open_ = F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)
    bins = rows.groupBy("source", "target", "bin").agg(F.sum(open_).alias("bin_size"), F.sum(F.col("whole") * F.col("size")).alias("sure"))
    own = W.partitionBy("source")
    along = own.orderBy(F.col("bin").asc_nulls_first())
    bins = bins.withColumn("left", F.col("target") - F.sum("sure").over(own))
    bins = bins.withColumn("end", F.sum("bin_size").over(along.rowsBetween(W.unboundedPreceding, 0)))
    over = F.when((F.col("end") > F.col("left")) & F.col("bin").isNotNull(), F.struct("bin", (F.col("end") - F.col("bin_size")).alias("before")))
    cut = bins.groupBy("source").agg(F.min(over).alias("cut"), F.first("left").alias("left"))
    cut = checkpointed(cut.select("source", "left", F.coalesce("cut.bin", F.lit(BINS + 1)).alias("cut_bin"), F.coalesce("cut.before", F.lit(0)).alias("before")))

    slim = rows.select("source", "rank", "doc_id", "size", "bin")
    inside = _with_source(slim, cut).filter("bin = cut_bin")
    so_far = F.sum("size").over(own.orderBy(_place()).rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    last = inside.withColumn("so_far", so_far).filter("so_far <= left").groupBy(F.col("source").alias("own_source")).agg(F.max(_place()).alias("last"), F.max("so_far").alias("so_far"))
    cut = cut.join(last, F.col("source").eqNullSafe(F.col("own_source")), "left")
    cut = checkpointed(cut.select("source", "cut_bin", "last", (F.col("left") - F.coalesce("so_far", "before")).alias("gap")))

    miss = F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), _place().alias("place"), "gap")
    rest = _with_source(slim, cut).filter(_after(F.col("last")) & (F.col("size") > 0))
    closing = rest.groupBy(F.col("source").alias("own_source")).agg(F.min(miss).alias("closing"))
    cut = cut.join(closing, F.col("source").eqNullSafe(F.col("own_source")), "left")
    return checkpointed(cut.select("source", "cut_bin", "last", F.when(F.col("closing.miss") < F.col("closing.gap"), F.col("closing.place")).alias("closing")))


def _decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds copies."""
    rows = _with_source(rows, cuts)
    more = F.col("rank").isNotNull() & (~_after(F.col("last")) | F.coalesce(_place() == F.col("closing"), F.lit(False)))
    return rows.withColumn("copies", (F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")).cast("int"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, importance: Column | None, *more: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), *more, (F.lit(1) if importance is None else importance).alias("weight"))
    bounded = F.least(F.greatest(F.coalesce(F.col("weight").cast("long"), F.lit(1)), F.lit(1)), F.lit(MOST_IMPORTANT))
    return rows.withColumn("weight", bounded.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3, importance: Column | None = None, salt: str = "mix") -> DataFrame:
    """How often the mix takes each row: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    The size of a document is its number of words (0 for a null text). The copies expected of a source's documents are in proportion
    to their `importance` (all alike if none is given; whole numbers from 1 to MOST_IMPORTANT, others are moved there, null is 1),
    but never over `most_copies`, and give the source's target together. The whole part is allocated at once. What is left is
    the inclusion probability p of a Pareto order sample: with u the document's own random number, documents are ranked by (u / (1 - u)) / (p / (1 - p)) and taken
    in that order as long as the source's target allows; one later document, whose size is nearest to the gap, closes it if that
    comes nearer to the target. Reruns agree: u depends on id, size and salt alone.

    Ties of rank go to the smaller id, then the smaller size; rows alike in all three are taken alike. A null source is a source;
    sources of size 0 have target 0. An empty table gives no rows; other columns are ignored.

    Ranks of a source are never collected: documents fall into bins of about equal count, bin totals are summed along a
    source, and only the rows of the bin in which a source ends are sorted.
    """
    base = checkpointed(_sized(docs, id_col, text_col, source_col, importance))
    rows = _ranked(_with_source(base, checkpointed(_plan(base, weights, most_copies))), most_copies, salt)
    out = _decided(rows, _cuts(rows))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3, importance: Column | None = None, salt: str = "mix") -> DataFrame:
    """The rows of `docs` with all their columns, each as often as `mix` takes it. A row is decided by its own values and its source's cut, so texts are not shuffled."""
    base = checkpointed(_sized(docs, id_col, text_col, source_col, importance))
    per = checkpointed(_plan(base, weights, most_copies))
    cuts = _cuts(_ranked(_with_source(base, per), most_copies, salt))
    whole = _sized(docs, id_col, text_col, source_col, importance, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    out = _decided(_ranked(_with_source(whole, per), most_copies, salt), cuts)
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
