"""Frames and documents as streams: counts by event time, causal filtering with state, incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from phaseloom.operators import corpus, hmm

STATES = "video long, frame long, state long"


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total: tumbling counts; rows later than the watermark are dropped."""
    windows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events without a longer gap."""
    found = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def filtered_states(frames: DataFrame, log_pi: np.ndarray, log_a: np.ndarray) -> DataFrame:
    """video, frame, state of a stream of (video, frame, emission), emissions as hmm.with_emissions adds them: the likeliest phase given all frames so far.

    The state of a video is its last posterior, one vector; a frame is expected after those before it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, own = hmm.causal_filter(batches, state.get if state.exists else None, log_pi, log_a)
        if own is not None:
            state.update((own.tolist(),))
        yield out.astype("int64")

    return frames.select("video", "frame", "emission").groupBy("video").applyInPandasWithState(run, STATES, "posterior array<double>", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """State of a video: the frame that is next, the posterior before it, and frames that came too early."""

    def __init__(self, log_pi: np.ndarray, log_a: np.ndarray, first: int, patience: int) -> None:
        self.log_pi, self.log_a, self.first, self.patience = log_pi, log_a, first, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, posterior array<double>")
        self.held = handle.getMapState("held", "frame long", "emission array<double>, ts long")

    def _go_on(self, video: int, upto: int, own: list[float] | None, fresh: dict[int, tuple]) -> tuple[list[tuple], int, list[float] | None]:
        """Filters from frame `upto` for as long as the next frame is there, among the fresh ones or those held."""
        out = []
        while True:
            if upto in fresh:
                emission = fresh.pop(upto)[0]
            elif self.held.containsKey((upto,)):
                emission = self.held.getValue((upto,))[0]
                self.held.removeKey((upto,))
            else:
                return out, upto, own
            row = pd.DataFrame({"video": [video], "frame": [upto], "emission": [np.array(emission)]})
            done, posterior = hmm.causal_filter(iter([row]), None if own is None else (own,), self.log_pi, self.log_a)
            out.append((video, upto, int(done["state"].iloc[0])))
            upto, own = upto + 1, posterior.tolist()

    def _wait(self) -> None:
        """One timer, for the earliest of the frames held."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        waiting = [row[1] for row in self.held.values()]
        if waiting:
            self.handle.registerTimer(min(waiting) + self.patience)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        upto, own = self.place.get() if self.place.exists() else (self.first, None)
        fresh, passed = {}, []
        for part in rows:
            for frame, emission, ts in zip(part["frame"].tolist(), part["emission"].tolist(), part["ts"].astype("int64") // 10**6, strict=True):
                if frame < upto or frame in fresh or self.held.containsKey((frame,)):
                    passed.append((key[0], frame, None))
                else:
                    fresh[frame] = (list(emission), int(ts))
        done, upto, own = self._go_on(key[0], upto, own, fresh)
        for frame, row in fresh.items():
            self.held.updateValue((frame,), row)
        self.place.update((upto, own))
        self._wait()
        yield _states(done + passed)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        upto, own = self.place.get()
        waiting = [k[0] for k in self.held.keys()]
        done = []
        if waiting:
            done, upto, own = self._go_on(key[0], min(waiting), own, {})
            self.place.update((upto, own))
        self._wait()
        yield _states(done)

    def close(self) -> None:
        pass


def _states(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.array([r[k] for r in rows], "Int64") for k, name in enumerate(("video", "frame", "state"))})


def ordered_states(frames: DataFrame, log_pi: np.ndarray, log_a: np.ndarray, late: str = "10 minutes", patience: int = 60_000, first: int = 1) -> DataFrame:
    """video, frame, state of a stream of (video, frame, ts, emission) whose frames come in any order: a frame waits until all before it are there, then gets its likeliest phase.

    A gap is given up when the watermark (`late` behind the newest ts) is `patience` milliseconds past the earliest frame that waits; the frames go on as if
    the missing ones had never been, as the batch filter does. A frame that comes after that, or again, gives a row with a null state and changes nothing. A video's state is one vector and
    the frames that wait. The session's state store must be the RocksDB provider (`spark.sql.streaming.stateStore.providerClass`).
    """
    rows = frames.select("video", "frame", F.col("ts").cast("timestamp").alias("ts"), "emission").withWatermark("ts", late)
    return rows.groupBy("video").transformWithStateInPandas(_InOrder(log_pi, log_a, first, patience), STATES, "append", "EventTime")


def ingest(documents: DataFrame, path: str, checkpoint: str, buckets: int = 16):
    """A query that keeps a table of chunks in step with a stream of (document_id, version, text): each batch replaces its documents' chunks.

    Of a batch's rows of one document the highest version counts, of equal versions the text that sorts last; a version below the stored one changes nothing. A document without chunks keeps one row
    without content, so that its old chunks go. Documents lie in `buckets` folders by a hash of their id; a batch rewrites the folders that it touches. Null ids are left out.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.filter(F.col("document_id").isNotNull())
        latest = named.groupBy("document_id").agg(F.max(F.struct(F.coalesce("version", F.lit(0)).cast("long").alias("version"), F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("document_id", "x.*")
        parts = corpus.chunks(latest, "document_id", "text").withColumn("hash", F.sha2("content", 256))
        parts = latest.select("document_id", "version").join(parts, "document_id", "left")
        parts = parts.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
        try:
            stored = spark.read.schema(parts.schema).parquet(path)
        except AnalysisException:  # nothing is stored yet
            stored = spark.createDataFrame([], parts.schema)
        touched = [r["bucket"] for r in parts.select("bucket").distinct().collect()]  # at most `buckets` numbers
        stored = stored.filter(F.col("bucket").isin(touched))
        known = stored.groupBy("document_id").agg(F.max("version").alias("known"))
        fresh = parts.join(known, "document_id", "left").filter(F.col("known").isNull() | (F.col("version") >= F.col("known"))).drop("known")
        rest = stored.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
        whole = rest.unionByName(fresh).select(parts.columns).checkpoint()  # read before its folders are written anew
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that `ingest` keeps, without the rows of documents that have none."""
    return spark.read.parquet(path).filter(F.col("content").isNotNull())
