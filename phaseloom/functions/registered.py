"""Functions for `spark.sql`, by name: bins and clipped losses, calibration over bins, and tables of segments and of areas under curves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: SQL bodies, which the optimiser sees through.
SCALARS = (
    "probability_bin(p DOUBLE) RETURNS BIGINT RETURN CASE WHEN p IS NULL THEN NULL " + " ".join(f"WHEN p >= {k * 0.1!r}D THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END",
    "clipped_log_loss(p DOUBLE, label BIGINT, clip DOUBLE DEFAULT 1e-7D) RETURNS DOUBLE RETURN -ln(greatest(least(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1 - clip), clip))",
)


def _calibration_error(n: pa.Array, predicted: pa.Array, observed: pa.Array) -> float | None:
    rows = [(k, p, o) for k, p, o in zip(n.to_pylist(), predicted.to_pylist(), observed.to_pylist(), strict=True) if k and p is not None and o is not None]
    total = sum(k for k, _, _ in rows)
    return sum(k * abs(p - o) for k, p, o in rows) / total if total else None


def _schema_of(table: AnalyzeArgument, names: tuple[str, ...]) -> dict:
    have = {f.name: f.dataType for f in table.dataType.fields}
    missing = [c for c in names if c not in have]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(have)}")
    return have


class Segments:
    """segments(TABLE t, key, order, phase): key, seg_no, phase, start, end, duration of maximal runs of one phase.

    Spark partitions by the key and sorts by the order; what is kept is the run that is open, so a long video needs no memory. A null phase goes on with the run before it, or with the first that has one.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, phase: AnalyzeArgument) -> AnalyzeResult:
        have = _schema_of(rows, (key.value, order.value, phase.value))
        out = StructType().add(key.value, have[key.value]).add("seg_no", LongType()).add("phase", have[phase.value]).add("start", have[order.value]).add("end", have[order.value]).add("duration", LongType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(f"`{key.value}`")], orderBy=[OrderingColumn(f"`{order.value}`")])

    def __init__(self) -> None:
        self.open, self.number, self.last = None, 0, None

    def eval(self, row: Row, key: str, order: str, phase: str) -> Iterator[tuple]:
        at, now = row[order], row[phase]
        if self.open is not None and now is not None and self.last is not None and now != self.last:
            yield tuple(self.open)
            self.open, self.number = None, self.number + 1
        if self.open is None:
            self.open = [row[key], self.number, now, at, at, 0]
        if now is not None:
            self.open[2] = self.last = now
        self.open[4], self.open[5] = at, self.open[5] + 1

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield tuple(self.open)


class RankingAreas:
    """ranking_areas(TABLE t, key): key, n_pos, n_neg, auroc, average_precision of rows (key, prob, pos, neg), best scores first.

    pos and neg count the rows of a score, so the query groups by key and score before; equal scores that were not grouped count as one. Spark sorts, and the
    function keeps five numbers. Rows without score are left out; auroc is null without both classes, average_precision without positives.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        have = _schema_of(rows, (key.value, "prob", "pos", "neg"))
        out = StructType().add(key.value, have[key.value]).add("n_pos", LongType()).add("n_neg", LongType()).add("auroc", DoubleType()).add("average_precision", DoubleType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(f"`{key.value}`")], orderBy=[OrderingColumn("prob", ascending=False)])

    def __init__(self) -> None:
        self.key, self.seen, self.prob, self.own = None, False, None, (0, 0)
        self.hits, self.misses, self.lost, self.precision = 0, 0, 0.0, 0.0

    def _close(self) -> None:
        """Adds the score that is open: positives lose to the negatives above and half of their own."""
        pos, neg = self.own
        self.lost += pos * (self.misses + 0.5 * neg)
        self.hits, self.misses = self.hits + pos, self.misses + neg
        if pos:
            self.precision += pos * self.hits / (self.hits + self.misses)
        self.own = (0, 0)

    def eval(self, row: Row, key: str) -> None:
        self.key, self.seen = row[key], True
        if row["prob"] is None:
            return
        if self.prob is not None and row["prob"] != self.prob:
            self._close()
        self.prob, self.own = row["prob"], (self.own[0] + (row["pos"] or 0), self.own[1] + (row["neg"] or 0))

    def terminate(self) -> Iterator[tuple]:
        if self.seen:
            self._close()
            pairs = self.hits * self.misses
            yield self.key, self.hits, self.misses, 1 - self.lost / pairs if pairs else None, self.precision / self.hits if self.hits else None


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; doing it again changes nothing.

    `calibration_error(n, predicted, observed)` aggregates the bins of a group, ten rows, into its expected calibration error.
    """
    for body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    spark.udf.register("calibration_error", F.arrow_udf(_calibration_error, "double"))
    spark.udtf.register("segments", F.udtf(Segments))
    spark.udtf.register("ranking_areas", F.udtf(RankingAreas))
