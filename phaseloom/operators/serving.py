"""Lookups of asked windows: their frames, truth and times, the band around them and the transitions next to them; what is not there is said in the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN_UNIT = "unknown/unverified"


def frame_index(frames: DataFrame, size: int = 8) -> DataFrame:
    """video, first_frame, frames: the `size` frame numbers from each frame on; fewer at a video's end."""
    ahead = W.partitionBy("video").orderBy("frame").rowsBetween(0, size - 1)
    return frames.select("video", F.col("frame").alias("first_frame"), F.collect_list("frame").over(ahead).alias("frames"))


def window_frames(asked: DataFrame, windows: DataFrame, frames: DataFrame, size: int = 8) -> DataFrame:
    """Adds frames, first_frame, last_frame and error to asked (video, window_start): the frames of the kept window at that index.

    A window's place among its video's kept windows is its index less the video's first. An asked video without windows has the error `unknown video`; an
    index outside of the video's, or none, `no such window`; a window whose frames are fewer than `size`, `frames missing`. Asked rows stay one row each.
    """
    span = windows.groupBy("video").agg(F.min("window_start").alias("_low"), F.count("*").alias("_n"))
    places = windows.select("video", F.col("local_index").alias("_place"), F.col("first_frame").alias("_first"))
    rows = asked.join(span, "video", "left").withColumn("_place", F.col("window_start") - F.col("_low"))
    rows = rows.join(places, ["video", "_place"], "left")
    listed = frame_index(frames, size).select("video", F.col("first_frame").alias("_first"), F.col("frames").alias("_frames"))
    rows = rows.join(listed, ["video", "_first"], "left")
    inside = F.coalesce((F.col("_place") >= 0) & (F.col("_place") < F.col("_n")), F.lit(False))
    error = F.when(F.col("_n").isNull(), "unknown video").when(~inside, "no such window").when(F.coalesce(F.size("_frames"), F.lit(0)) < size, "frames missing")
    rows = rows.withColumn("error", error).withColumn("frames", F.when(error.isNull(), F.col("_frames")))
    rows = rows.withColumn("first_frame", F.element_at("frames", 1)).withColumn("last_frame", F.element_at("frames", -1))
    return rows.drop("_low", "_n", "_place", "_first", "_frames")


def with_truth(asked: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds truth_phase and truth_flag of the asked (video, window_start); both null if the video has no such window."""
    known = windows.select("video", "window_start", F.col("last_frame_phase").alias("truth_phase"), F.col("consistency_flag").alias("truth_flag"))
    return asked.join(known, ["video", "window_start"], "left")


def with_times(asked: DataFrame, times: DataFrame) -> DataFrame:
    """Adds time_start, time_end, time_mid, time_length, time_available, time_unit, n_zero_steps of the asked (video, window_start).

    Windows without a row in `times` (video, window_start, start_time, end_time, mid_time, duration, n_zero_steps, is_complete), or with an incomplete
    one, get the default record: nulls, not available. The unit is never known.
    """
    whole = times.filter("is_complete").select(
        "video", "window_start", F.col("start_time").alias("time_start"), F.col("end_time").alias("time_end"), F.col("mid_time").alias("time_mid"),
        F.col("duration").alias("time_length"), "n_zero_steps", F.lit(True).alias("time_available"),
    )
    rows = asked.join(whole, ["video", "window_start"], "left")
    return rows.withColumn("time_available", F.coalesce("time_available", F.lit(False))).withColumn("time_unit", F.lit(UNKNOWN_UNIT))


def band(asked: DataFrame, windows: DataFrame, key: str, before: int = 5, after: int = 5) -> DataFrame:
    """key, video, window_start, offset, is_center of the windows within `before` and `after` places of each asked (key, video, window_start), none of another video.

    Asked windows that do not exist have no rows. A window is asked for by its place, so each place of the band is one equality.
    """
    if before < 0 or after < 0 or before + after < 1:
        raise ValueError("a band needs a window before or after, and no negative number of them")
    place = windows.select("video", "window_start", F.col("local_index").alias("_place"))
    centre = asked.select(key, "video", "window_start").join(place, ["video", "window_start"])
    wanted = centre.select(key, "video", F.explode(F.sequence(F.col("_place") - before, F.col("_place") + after)).alias("_at"), F.col("_place").alias("_centre"))
    found = wanted.join(place.withColumnRenamed("_place", "_at"), ["video", "_at"])
    return found.select(key, "video", "window_start", (F.col("_at") - F.col("_centre")).alias("offset"), (F.col("_at") == F.col("_centre")).alias("is_center"))


def transition_context(asked: DataFrame, events: DataFrame, key: str, at: str = "window_start") -> DataFrame:
    """key, n_before, n_after, last, next (structs of no, from_phase, to_phase, window_start, window_end, distance, is_skip) of each asked (key, video, `at`).

    `last` begins at or before the asked place, `next` after it; `no` counts the video's transitions from 0. Nothing is selected, and there is no row, where a
    video has fewer than two transitions or the place is null. A video's transitions are one list beside its questions, bounded by its phases' changes.
    """
    order = W.partitionBy("video").orderBy("window_start", "window_end")
    view = ["no", "from_phase", "to_phase", "window_start", "window_end", "distance", "is_skip"]
    numbered = events.withColumn("no", (F.row_number().over(order) - 1).cast("long"))
    lists = numbered.groupBy("video").agg(F.sort_array(F.collect_list(F.struct(*view))).alias("_all")).filter(F.size("_all") >= 2)
    rows = asked.select(key, "video", F.col(at).alias("_at")).filter(F.col("_at").isNotNull()).join(lists, "video")
    before, later = (F.filter("_all", lambda e: e["window_start"] <= F.col("_at")), F.filter("_all", lambda e: e["window_start"] > F.col("_at")))
    return rows.select(key, F.size(before).cast("long").alias("n_before"), F.size(later).cast("long").alias("n_after"), F.get(before, F.size(before) - 1).alias("last"), F.get(later, 0).alias("next"))
