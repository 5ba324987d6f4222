"""Registry tables: listings with access rules, search, natural order, pages, change sets, set audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.operators.sampling import running_total

#: Columns that are never projected or searched.
SECRET = ("password", "global_access")


def listing(users: DataFrame, roles: DataFrame, key: str, role: str) -> DataFrame:
    """Users joined with their role rows, of one role, without secret columns, by key."""
    keep = [c for c in roles.columns if c not in SECRET and c != key]
    return users.join(roles.select(key, *keep), key).filter(F.col("role") == role).drop(*SECRET).orderBy(key)


def accessible(rows: DataFrame, owner: str, user: int, everything: bool) -> DataFrame:
    """Rows that a user owns, or all for one with global access."""
    return rows.filter(F.lit(everything) | (F.col(owner) == user))


def search(rows: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose columns, joined, hold the term in any case; secret columns are never searched."""
    columns = [c for c in (columns or rows.columns) if c not in SECRET]
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(term.lower())))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows in a total order, pages counting from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def natural_key(name: Column) -> Column:
    """A text that sorts as people count: digits are padded to 12 places, letters folded to lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d+$")), F.lpad(p, 12, "0")).otherwise(p)), "")


def number_in(name: Column, prefix: str) -> Column:
    """The number behind a prefix, as in Patient_17; null if there is none."""
    return F.nullif(F.regexp_extract(name, prefix + r"(\d+)", 1), F.lit("")).cast("long")


def dense_ids(rows: DataFrame, name: str) -> DataFrame:
    """Names with new ids from 0 in natural order."""
    return running_total(rows.select(name).distinct(), natural_key(F.col(name)), F.lit(1), "new_id", name).select(name, F.col("new_id").cast("long"))


def replace_values(rows: DataFrame, mapping: dict[str, str], missing: str = "NA") -> DataFrame:
    """The mapping applied to every text column, then nulls there filled."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    return rows.replace(mapping, subset=texts).na.fill(missing, texts)


def apply_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows after a change set (key, op: insert, update or delete, and all columns): keys that change are taken out, inserted and updated rows put in; null values of an update keep the old ones."""
    stay = rows.join(changes.select(key), key, "left_anti")
    old = rows.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in rows.columns if c != key])
    new = changes.filter("op <> 'delete'").join(old, key, "left")
    value = [F.col(key), *[F.when(F.col("op") == "update", F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c in rows.columns if c != key]]
    return stay.select(rows.columns).unionByName(new.select(*value).select(rows.columns))


def set_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """n_left, n_right, n_both, n_only_left, n_only_right of distinct keys."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_only_left"), F.count_if(F.col("_l").isNull()).alias("n_only_right"))


def leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the number of splits."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")
