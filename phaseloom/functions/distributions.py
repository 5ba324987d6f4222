"""Columns over distributions: maps or arrays of probabilities by phase."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranked(probs: Column) -> Column:
    """Entries (key, value) of a map, the likeliest first, ties by name."""
    return F.transform(F.array_sort(F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def top_k(probs: Column, k: int) -> Column:
    """The k likeliest entries as a map in that order."""
    return F.map_from_entries(F.slice(ranked(probs), 1, k))


def omitted(probs: Column, k: int) -> Column:
    """(mass, count) of the entries beyond the k likeliest."""
    rest = F.slice(ranked(probs), k + 1, 1_000_000)
    return F.struct(F.aggregate(rest, F.lit(0.0), lambda s, e: s + e["value"]).alias("mass"), F.size(rest).alias("count"))


def leader(probs: Column) -> Column:
    return F.get(ranked(probs), 0)["key"]


def runner_up(probs: Column) -> Column:
    return F.get(ranked(probs), 1)["key"]


def gap(probs: Column) -> Column:
    """How far the likeliest is ahead of the next; null with fewer than two entries."""
    r = ranked(probs)
    return F.get(r, 0)["value"] - F.get(r, 1)["value"]


def first_argmax(values: Column) -> Column:
    """The first place, from 0, of an array's largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def entropy(probs: Column) -> Column:
    """Entropy in nats of a map's values; zeros add nothing."""
    return F.aggregate(F.map_values(probs), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def quantile(pmf: Column, q: float) -> Column:
    """The first place, from 1, at which an array's running sum reaches the share q of its total, but for rounding (1e-12); the last if none does."""
    total = F.aggregate(pmf, F.lit(0.0), lambda s, x: s + x)
    sums = F.aggregate(pmf, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))
    at = F.size(F.filter(sums, lambda s: s < (q - 1e-12) * total)) + 1
    return F.least(at, F.size(pmf)).cast("long")
