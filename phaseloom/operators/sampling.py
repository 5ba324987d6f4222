"""Splits, balancing and permutation controls that any engine can repeat: order comes from MD5, never from a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(*cols: Column, salt: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(salt), *cols).cast("binary"))


#: Boundaries of ordered blocks are every sixteenth of so many values, the first in hash order.
SAMPLED = 4096


def running_total(rows: DataFrame, order: Column, amount: Column, name: str, *ties: str) -> DataFrame:
    """Adds `name`: the sum of `amount` over all rows that come before in `order`, then `ties`; nulls come first.

    Rows fall into ordered blocks between boundaries drawn from the values, so no task sorts more than a block unless one value
    has more rows; the totals of the at most 257 blocks are summed on top.
    """
    own = rows.withColumn("_o", order).withColumn("_a", amount)
    few = own.select("_o").filter("_o is not null").orderBy(F.xxhash64("_o"), "_o").limit(SAMPLED).agg(F.array_sort(F.collect_set("_o")).alias("_bounds"))
    few = few.select(F.filter("_bounds", lambda x, i: i % 16 == 0).alias("_bounds"))
    own = own.join(F.broadcast(few)).withColumn("_block", F.size(F.filter("_bounds", lambda b: b <= F.col("_o")))).drop("_bounds")
    total = own.groupBy("_block").agg(F.sum("_a").alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_a").over(W.partitionBy("_block").orderBy("_o", *ties).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn(name, inside).join(F.broadcast(total.select("_block", before.alias("_before"))), "_block")
    return own.withColumn(name, F.col(name) + F.col("_before")).drop("_o", "_a", "_block", "_before")


def group_split(rows: DataFrame, key: str, train: float = 0.70, val: float = 0.15, salt: str = "split") -> DataFrame:
    """key, split: groups in hash order, the first share to train, the next to val, the rest to test."""
    groups = rows.select(key).distinct()
    n = groups.agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(groups, shuffle_key(F.col(key), salt=salt), F.lit(1), "_p", key)
    groups = placed.join(F.broadcast(n)).withColumn("_p", (F.col("_p") + 1) / F.col("_n"))
    return groups.select(key, F.when(F.col("_p") <= train, "train").when(F.col("_p") <= train + val, "val").otherwise("test").alias("split"))


def sample_groups(rows: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """Rows of n groups, the first in hash order."""
    few = rows.select(key).distinct().orderBy(shuffle_key(F.col(key), salt=salt), key).limit(n)
    return rows.join(few, key, "left_semi")


def undersample(rows: DataFrame, label: str, *ids: str, salt: str = "balance") -> DataFrame:
    """As many rows of each label as the rarest has, the first in hash order of their ids.

    The cut is found in the hash's first digits: labels keep whole bins of hashes, and only one bin of a label is sorted.
    """
    own = rows.withColumn("_h", shuffle_key(*[F.col(i) for i in ids], salt=salt)).withColumn("_bin", F.substring("_h", 1, 2))
    bins = own.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    least = bins.groupBy(label).agg(F.sum("_n").alias("_t")).agg(F.min("_t").alias("_least"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(label).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(label, "_bin", before.alias("_before")).join(F.broadcast(least)).filter("_before < _least")
    rank = F.row_number().over(W.partitionBy(label, "_bin").orderBy("_h", *ids))
    kept = own.join(bins, [label, "_bin"]).withColumn("_r", rank).filter(F.col("_before") + F.col("_r") <= F.col("_least"))
    return kept.drop("_h", "_bin", "_before", "_least", "_r")


def shuffle_within(series: DataFrame, values: list[str], salt: str = "control") -> DataFrame:
    """Each video's values moved to other frames of it, by hash order; frames stay. A model that ignores order must not notice."""
    place = F.row_number().over(W.partitionBy("video").orderBy("frame"))
    other = F.row_number().over(W.partitionBy("video").orderBy(shuffle_key(F.col("video"), F.col("frame"), salt=salt), "frame"))
    return series.select("video", "frame", place.alias("_p")).join(series.select("video", *values, other.alias("_p")), ["video", "_p"]).drop("_p")
