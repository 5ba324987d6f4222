"""Frames to windows, segments, transitions, bands and timelines: ordered-phase series as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

N_PHASES = 15


def frames_from_events(events: DataFrame) -> DataFrame:
    """Events as frames: video (user), frame (1, 2, ... by time and id), value, and an ordinal phase that rises with the frame."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    frames = events.select(F.col("user_id").alias("video"), F.row_number().over(order).cast("long").alias("frame"), "value", "event_id")
    step = F.floor((F.col("frame") - 1) / 12)
    phase = F.least(F.lit(N_PHASES - 1), step + F.when(step % 3 == 2, 1).otherwise(0) + F.when(F.col("value") > 150, 1).otherwise(0))
    return frames.withColumn("phase", phase.cast("long"))


def running_offset(counts: DataFrame, key: str, count: str, block: int = 4096) -> DataFrame:
    """counts plus `offset`, the sum of the counts of smaller keys: summed within blocks of keys, then over the blocks' totals."""
    own = counts.withColumn("_block", F.floor(F.col(key) / block))
    total = own.groupBy("_block").agg(F.sum(count).alias("_total"))
    before = F.coalesce(F.sum("_total").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(count).over(W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.join(total.select("_block", before.alias("_before")), "_block").withColumn("offset", inside + F.col("_before")).drop("_block", "_before")


def window_times(frames: DataFrame, size: int = 8) -> DataFrame:
    """video, first_frame, start_time, end_time, mid_time, duration, n_zero_steps, time_available of each full window of `size` frames of (video, frame, time).

    Times are seconds; n_zero_steps counts neighbouring frames of one time. Where a frame has no time, the window's times are null and time_available is 0.
    """
    order = W.partitionBy("video").orderBy("frame")
    ahead, steps = order.rowsBetween(0, size - 1), order.rowsBetween(1, size - 1)
    rows = frames.select("video", "frame", "time", (F.col("time") == F.lag("time").over(order)).cast("long").alias("_same"))
    rows = rows.select("video", F.col("frame").alias("first_frame"), F.count(F.lit(1)).over(ahead).alias("_n"), F.count("time").over(ahead).alias("_known"), F.first("time").over(ahead).alias("_a"), F.last("time").over(ahead).alias("_b"), F.coalesce(F.sum("_same").over(steps), F.lit(0)).alias("n_zero_steps"))
    known = F.col("_known") == size
    times = {"start_time": F.col("_a"), "end_time": F.col("_b"), "mid_time": (F.col("_a") + F.col("_b")) / 2, "duration": F.col("_b") - F.col("_a")}
    return rows.filter(F.col("_n") == size).select("video", "first_frame", *[F.when(known, c).alias(n) for n, c in times.items()], "n_zero_steps", known.cast("long").alias("time_available"))


def aligned(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables, one for each key; an error if a key is missing on one side or repeated on one. The check is one count of keys, before anything is joined."""
    sides = first.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(second.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    apart = sides.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).filter("_a <> 1 or _b <> 1").count()
    if apart:
        raise ValueError(f"{apart} keys are not once in each table")
    return first.join(second, keys)


def sliding_windows(frames: DataFrame, size: int = 8, stride: int = 1, any_phases: bool = False) -> DataFrame:
    """Full windows of `size` frames: video, first_frame, first_frame_phase, last_frame_phase, consistency_flag, local_index.

    A window stays if its phases are one or two neighbours, which is max - min <= 1; `any_phases` keeps all. The flag
    tells whether the first phase differs from the last. local_index counts a video's kept windows from 0.
    """
    order = W.partitionBy("video").orderBy("frame")
    ahead = order.rowsBetween(0, size - 1)
    rows = frames.select(
        "video",
        F.col("frame").alias("first_frame"),
        F.count("phase").over(ahead).alias("n"),
        (F.max("phase").over(ahead) - F.min("phase").over(ahead)).alias("spread"),
        F.first("phase").over(ahead).alias("first_frame_phase"),
        F.last("phase").over(ahead).alias("last_frame_phase"),
        (F.row_number().over(order) - 1).alias("place"),
    )
    kept = rows.filter((F.col("n") == size) & (F.col("place") % stride == 0))
    kept = kept if any_phases else kept.filter("spread <= 1")
    flag = (F.col("first_frame_phase") != F.col("last_frame_phase")).cast("long")
    index = F.row_number().over(W.partitionBy("video").orderBy("first_frame")) - 1
    return kept.select("video", "first_frame", "first_frame_phase", "last_frame_phase", flag.alias("consistency_flag"), index.cast("long").alias("local_index"))


def with_window_start(windows: DataFrame) -> DataFrame:
    """Adds window_start, the running index over the kept windows of all videos in the order of their ids."""
    offsets = running_offset(windows.groupBy("video").agg(F.count(F.lit(1)).alias("n")), "video", "n").select("video", "offset")
    return windows.join(offsets, "video").withColumn("window_start", F.col("local_index") + F.col("offset")).drop("offset")


def phase_grid(spark, n: int = N_PHASES) -> DataFrame:
    """All pairs a, b of phase indices: a table of fixed size."""
    return spark.range(n * n).select(F.floor(F.col("id") / n).alias("a"), (F.col("id") % n).alias("b"))


def transition_matrix(windows: DataFrame, n: int = N_PHASES) -> DataFrame:
    """first_phase, last_phase, n for every pair of phases, zeros included."""
    counts = windows.groupBy(F.col("first_frame_phase").alias("a"), F.col("last_frame_phase").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return phase_grid(windows.sparkSession, n).join(F.broadcast(counts), ["a", "b"], "left").select(F.col("a").alias("first_phase"), F.col("b").alias("last_phase"), F.coalesce("n", F.lit(0)).alias("n"))


def explode_annotations(ranges: DataFrame, frames: DataFrame, last_wins: bool = False) -> DataFrame:
    """Frames with the phases of the ranges (video, phase, frame_start, frame_end, both included; range_no) that hold them.

    Overlapping ranges give one row each, or only the later one. A range is expanded to its frames and joined by equality.
    """
    spread = ranges.filter("frame_start <= frame_end").select("video", "range_no", F.col("phase").alias("range_phase"), F.explode(F.sequence("frame_start", "frame_end")).alias("frame"))
    if last_wins:
        spread = spread.groupBy("video", "frame").agg(F.max_by("range_phase", "range_no").alias("range_phase"), F.max("range_no").alias("range_no"))
    return frames.select("video", "frame").join(spread, ["video", "frame"])


def segments(series: DataFrame, phase: str = "phase", order: str = "frame") -> DataFrame:
    """Maximal runs of one phase: video, seg_no (from 0), phase, start, end, duration, n_segments, censoring.

    Censoring is LEFT for a video's first run, RIGHT for its last, BOTH for its only one, else OBSERVED.
    """
    along = W.partitionBy("video").orderBy(order)
    change = F.coalesce((F.col(phase) != F.lag(phase).over(along)).cast("long"), F.lit(0))
    rows = series.select("video", F.col(order).alias("_at"), F.col(phase).alias("phase"), change.alias("_change"))
    number = F.sum("_change").over(W.partitionBy("video").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    runs = rows.withColumn("seg_no", number).groupBy("video", "seg_no").agg(F.first("phase").alias("phase"), F.min("_at").alias("start"), F.max("_at").alias("end"), F.count(F.lit(1)).alias("duration"))
    runs = runs.withColumn("n_segments", F.count(F.lit(1)).over(W.partitionBy("video")))
    last = F.col("seg_no") == F.col("n_segments") - 1
    kind = F.when((F.col("seg_no") == 0) & last, "BOTH").when(F.col("seg_no") == 0, "LEFT").when(last, "RIGHT").otherwise("OBSERVED")
    return runs.withColumn("censoring", kind)


def transition_events(runs: DataFrame) -> DataFrame:
    """Neighbouring segments: video, seg_no, from_phase, to_phase, window_start (last of the first), window_end (first of the second), distance, is_skip."""
    along = W.partitionBy("video").orderBy("seg_no")
    pairs = runs.select("video", "seg_no", F.col("phase").alias("from_phase"), F.lead("phase").over(along).alias("to_phase"), F.col("end").alias("window_start"), F.lead("start").over(along).alias("window_end"))
    distance = F.col("to_phase") - F.col("from_phase")
    return pairs.filter(F.col("to_phase").isNotNull()).withColumn("distance", distance).withColumn("is_skip", (F.abs(distance) > 1).cast("long"))


def skips_returns_regressions(events: DataFrame) -> DataFrame:
    """Events with is_forward_skip (two phases on or more), is_regression (back) and is_return (to a phase left before)."""
    before = W.partitionBy("video").orderBy("seg_no").rowsBetween(W.unboundedPreceding, -1)
    left = F.collect_set("from_phase").over(before)
    return events.select(
        "video", "seg_no", "from_phase", "to_phase",
        (F.col("distance") >= 2).cast("long").alias("is_forward_skip"),
        (F.col("distance") < 0).cast("long").alias("is_regression"),
        F.array_contains(left, F.col("to_phase")).cast("long").alias("is_return"),
    )


def asof_transitions(series: DataFrame, events: DataFrame) -> DataFrame:
    """Each frame with its last transition (window_end <= frame) and its next one (window_end > frame): one pass over both, ordered."""
    marks = events.select("video", F.col("window_end").alias("frame"), F.struct("window_end", "from_phase", "to_phase").alias("event"), F.lit(0).alias("kind"))
    rows = series.select("video", "frame", F.lit(None).cast(marks.schema["event"].dataType).alias("event"), F.lit(1).alias("kind"))
    along = W.partitionBy("video").orderBy("frame", "kind")
    both = marks.unionByName(rows)
    both = both.withColumn("last", F.last("event", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("next", F.first("event", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)))
    return both.filter("kind = 1").select(
        "video", "frame",
        F.col("last.window_end").alias("last_at"), F.col("last.from_phase").alias("last_from"), F.col("last.to_phase").alias("last_to"),
        F.col("next.window_end").alias("next_at"), F.col("next.from_phase").alias("next_from"), F.col("next.to_phase").alias("next_to"),
    )


def stabbing(events: DataFrame, at: Column) -> DataFrame:
    """Events whose interval from window_start to window_end holds a place."""
    return events.filter(at.between(F.col("window_start"), F.col("window_end")))


def history_band(series: DataFrame, centres: DataFrame, before: int, after: int, most: int = 200) -> DataFrame:
    """Rows around each video's centre (video, centre): offset_from_center from -before to after, at most `most` to a side, clamped at the ends.

    truncated tells that the series ends within the band. Centres are one row for each video.
    """
    before, after = min(before, most), min(after, most)
    rows = series.withColumn("_row", F.row_number().over(W.partitionBy("video").orderBy("frame")))
    rows = rows.withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy("video")))
    rows = rows.join(centres, "video")
    rows = rows.withColumn("_mid", F.max(F.when(F.col("frame") == F.col("centre"), F.col("_row"))).over(W.partitionBy("video")))
    offset = F.col("_row") - F.col("_mid")
    cut = (F.col("_mid") - before < 1) | (F.col("_mid") + after > F.col("_rows"))
    return rows.withColumn("offset_from_center", offset.cast("long")).withColumn("truncated", cut.cast("long")).filter(offset.between(-before, after)).drop("_row", "_rows", "_mid")


def timeline(series: DataFrame, score: str = "score") -> DataFrame:
    """Runs of one phase with the mean score of their rows: video, seg_no, phase, start, end, mean_score."""
    runs = segments(series)
    along = W.partitionBy("video").orderBy("frame")
    change = F.coalesce((F.col("phase") != F.lag("phase").over(along)).cast("long"), F.lit(0))
    number = F.sum("_change").over(along.rowsBetween(W.unboundedPreceding, 0))
    means = series.withColumn("_change", change).withColumn("seg_no", number).groupBy("video", "seg_no").agg(F.avg(score).alias("mean_score"))
    return runs.join(means, ["video", "seg_no"]).select("video", "seg_no", "phase", "start", "end", "mean_score")


def duration_stats(runs: DataFrame) -> DataFrame:
    """For each phase: n, mean, median, std (sample), cv, quartiles, longest, and how many runs are censored, by kind."""
    quart = F.percentile("duration", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = runs.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean"), quart.alias("q"), F.stddev_samp("duration").alias("std"), F.max("duration").alias("longest"),
        *[F.count_if(F.col("censoring") == k).alias(f"n_{k.lower()}") for k in ("OBSERVED", "LEFT", "RIGHT", "BOTH")],
    )
    return out.select("phase", "n", "mean", F.col("q")[1].alias("median"), "std", (F.col("std") / F.col("mean")).alias("cv"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "longest", "n_observed", "n_left", "n_right", "n_both")


def dmax(runs: DataFrame, quantile: float = 0.99, explicit: int = 268) -> DataFrame:
    """One row: the longest run, the quantile of runs rounded up, and a given bound."""
    return runs.agg(F.max("duration").alias("observed_max"), F.ceil(F.percentile("duration", F.lit(quantile))).alias("quantile_max"), F.lit(explicit).cast("long").alias("explicit_max"))


def cv_groups(stats: DataFrame) -> DataFrame:
    """Phases by terciles of cv: low up to the first, middle up to the second, high above; null without cv."""
    cuts = stats.agg(F.percentile("cv", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"))
    group = F.when(F.col("cv") <= F.col("cut")[0], "low").when(F.col("cv") <= F.col("cut")[1], "middle").when(F.col("cv").isNotNull(), "high")
    return stats.join(F.broadcast(cuts)).select("phase", "cv", group.alias("cv_group"))


def segment_sanity(runs: DataFrame) -> DataFrame:
    """For each phase: segments, videos; and in both cases how often a segment begins elsewhere than right behind the one before."""
    along = W.partitionBy("video").orderBy("seg_no")
    gap = F.col("start") != F.lag("end").over(along) + 1
    rows = runs.withColumn("gap", F.coalesce(gap, F.lit(False)))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("n_segments"), F.count_distinct("video").alias("n_videos"), F.count_if("gap").alias("n_gaps"))


def change_points(series: DataFrame, column: str) -> DataFrame:
    """Rows whose value differs from the row before, where both are known: video, frame, before, after."""
    along = W.partitionBy("video").orderBy("frame")
    rows = series.select("video", "frame", F.lag(column).over(along).alias("before"), F.col(column).alias("after"))
    return rows.filter("before is not null and after is not null and before <> after")


def gap_extrema(series: DataFrame) -> DataFrame:
    """For each video of (video, frame, first, second): least and largest gap between two scores, each at its lowest frame, and the mean gap near (frame <= 12) and far."""
    rows = series.withColumn("gap", F.abs(F.col("first") - F.col("second")))
    least = F.min(F.struct("gap", "frame"))
    most = F.min(F.struct((-F.col("gap")).alias("gap"), "frame"))
    out = rows.groupBy("video").agg(least.alias("least"), most.alias("most"), F.avg(F.when(F.col("frame") <= 12, F.col("gap"))).alias("near"), F.avg(F.when(F.col("frame") > 12, F.col("gap"))).alias("far"))
    return out.select("video", F.col("least.gap").alias("min_gap"), F.col("least.frame").alias("min_gap_at"), (-F.col("most.gap")).alias("max_gap"), F.col("most.frame").alias("max_gap_at"), F.round("near", 6).alias("mean_gap_near"), F.round("far", 6).alias("mean_gap_far"))


def convergence(series: DataFrame) -> DataFrame:
    """For each video of (video, frame, first, second): the first frame at which the leader changes, and where the run of strictly falling gaps that ends just before it began.

    Videos whose leader never changes have no row.
    """
    along = W.partitionBy("video").orderBy("frame")
    rows = series.withColumn("gap", F.abs(F.col("first") - F.col("second"))).withColumn("lead", F.sign(F.col("first") - F.col("second")))
    rows = rows.withColumn("cross", (F.col("lead") != F.lag("lead").over(along)).cast("int")).withColumn("falls", F.coalesce(F.col("gap") < F.lag("gap").over(along), F.lit(False)))
    rows = rows.withColumn("crossing", F.min(F.when(F.col("cross") == 1, F.col("frame"))).over(W.partitionBy("video"))).filter("frame < crossing")
    back = W.partitionBy("video").orderBy(F.desc("frame")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.min(F.col("falls").cast("int")).over(back), F.lit(1)))
    return rows.filter("run = 1").groupBy("video").agg(F.first("crossing").alias("crossing"), F.min("frame").alias("converging_from"), F.count(F.lit(1)).alias("run_length"))


def stability(series: DataFrame, centres: DataFrame) -> DataFrame:
    """video, n_after, is_stable: whether all later rows have the phase of the centre; false if there are none."""
    rows = series.join(centres, "video")
    rows = rows.withColumn("mid", F.max(F.when(F.col("frame") == F.col("centre"), F.col("phase"))).over(W.partitionBy("video")))
    later = F.col("frame") > F.col("centre")
    out = rows.groupBy("video").agg(F.count_if(later).alias("n_after"), F.count_if(later & (F.col("phase") != F.col("mid"))).alias("other"))
    return out.select("video", "n_after", ((F.col("n_after") > 0) & (F.col("other") == 0)).cast("long").alias("is_stable"))


def matched_lag(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each video, the first event of `first` that `second` has too (same phases), and the first such: lag in frames, null if none."""
    a = first.select("video", "from_phase", "to_phase", F.col("window_end").alias("a_at"))
    b = second.select("video", "from_phase", "to_phase", F.col("window_end").alias("b_at"))
    best = a.join(b, ["video", "from_phase", "to_phase"]).groupBy("video").agg(F.min(F.struct("a_at", "b_at", "from_phase", "to_phase")).alias("m"))
    return first.select("video").distinct().join(best, "video", "left").select("video", F.col("m.from_phase").alias("from_phase"), F.col("m.to_phase").alias("to_phase"), (F.col("m.b_at") - F.col("m.a_at")).alias("lag"))


def exact_partner(windows: DataFrame, k: int) -> DataFrame:
    """Adds has_partner: the window k places earlier exists and is exactly k rows before."""
    along = W.partitionBy("video").orderBy("window_start")
    return windows.withColumn("has_partner", F.coalesce(F.lag("window_start", k).over(along) == F.col("window_start") - k, F.lit(False)).cast("long"))
