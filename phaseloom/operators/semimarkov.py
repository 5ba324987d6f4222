"""The explicit-duration model: phases that last as their durations say and lead strictly forward."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaseloom.operators.hmm import duration_counts, fit_negative_binomial, initial_distribution, log_table, negative_binomial, segment_probabilities
from phaseloom.operators.trajectory import N_PHASES, dmax, segments
from phaseloom.session import checkpointed

#: Rows that a task holds at once.
ROWS = 1 << 15

DECODED = "video long, frame long, filtered array<double>, state long, next_phase array<double>, next_state long, leave double, age double, change_prob double, change_k double"

FAMILIES, STRATEGIES = ("negative_binomial", "empirical"), ("observed", "quantile", "explicit")


@dataclass(frozen=True)
class Model:
    """Where videos begin, where segments lead (strictly forward: no phase follows itself) and how long phases last, P(1..dmax)."""

    pi: np.ndarray
    lead: np.ndarray
    pmf: np.ndarray
    hazard: np.ndarray = field(init=False)
    rest: np.ndarray = field(init=False)  # what is taken for the state where none explains the rows: phases that lead nowhere, at their last age

    def __post_init__(self):
        if np.tril(self.lead).any():
            raise ValueError("segments lead forward only; a phase that follows itself would be left and entered again")
        beyond = np.cumsum(self.pmf[:, ::-1], axis=1)[:, ::-1]  # P(duration >= age)
        hazard = np.where(beyond > 1e-300, self.pmf / np.maximum(beyond, 1e-300), 1.0)
        hazard[:, -1] = 1.0
        rest = np.zeros(self.pmf.shape)
        rest[:, -1] = self.lead.sum(axis=1) <= 0
        object.__setattr__(self, "hazard", hazard)
        object.__setattr__(self, "rest", rest / rest.sum())

    def start(self) -> np.ndarray:
        return np.zeros(self.pmf.shape)

    def ahead(self, state: np.ndarray) -> np.ndarray:
        """(video, phase, age) one row later: what is left goes to age 1 of other phases; a phase that leads nowhere loses what its durations end."""
        gone = state * self.hazard
        stay = state - gone
        out = np.zeros_like(state)
        out[..., 1:] = stay[..., :-1]
        out[..., 0] = gone.sum(axis=-1) @ self.lead
        return out


def fit(series: DataFrame, family: str = "negative_binomial", strategy: str = "observed", alpha: float = 2.0, rho: float = 0.5, n: int = N_PHASES) -> Model:
    """The model of a series (video, frame, phase): shares of first phases, smoothed shares of strictly forward steps, durations up to `trajectory.dmax` of the strategy.

    Durations of the family `negative_binomial` are the likeliest given whole segments and censored ones as lower bounds; `empirical` are the shares of
    whole segments plus 0.001. A phase of which no whole segment was seen lasts any time alike. Tables of one row for each phase and duration come to the driver.
    Segments are written to the checkpoint folder, as three tables are counted from them.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; known are {', '.join(FAMILIES)}")
    runs = checkpointed(segments(series))
    counts = duration_counts(runs).toPandas()
    most = longest_age(runs, strategy)
    pmf = np.full((n, most), 1.0 / most)
    for phase, own in counts.groupby("phase"):
        whole = ~own["is_censored"].to_numpy(bool)
        if not whole.any():
            continue
        length, k = np.minimum(own["duration"].to_numpy(int), most), own["n"].to_numpy(float)
        if family == "empirical":
            share = np.bincount(length[whole] - 1, k[whole], minlength=most) + 1e-3
            pmf[int(phase)] = share / share.sum()
        else:
            mean, size = fit_negative_binomial(length, k, ~whole)
            pmf[int(phase)] = negative_binomial(max(mean, 1.0001), size, most)
    pi, lead = (np.exp(log_table(t, n)) for t in (initial_distribution(series, n), segment_probabilities(runs, alpha, rho, n)))
    return Model(pi, np.where(lead > 1e-300, lead, 0.0), pmf)


def longest_age(runs: DataFrame, strategy: str) -> int:
    """`observed`: the longest segment; `quantile`: 99 % of them are no longer; `explicit`: 268."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    return max(1, int(dmax(runs).first()[f"{strategy}_max"] or 1))


def filtered(model: Model, b: np.ndarray, state: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """(video, phase, age) posteriors after each row of emissions (video, step, phase); `first` tells which videos begin with step 0."""
    for t in range(b.shape[1]):
        state = model.ahead(state)
        if t == 0:
            state[first] = 0.0
            state[first, :, 0] = model.pi
        state = state * np.exp(b[:, t] - b[:, t].max(axis=1, keepdims=True))[..., None]
        total = state.sum(axis=(1, 2), keepdims=True)
        state = np.where(total > 0, state / np.where(total > 0, total, 1.0), model.rest)
        yield state


def _decoded(model: Model, k: int, rate: float):
    n = len(model.pi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the video that goes on: its state and last frames

        def judged(held: list[tuple[int, list, list]]) -> Iterator[pa.RecordBatch]:
            held = sorted(([v, np.concatenate(f), np.concatenate(b)] for v, f, b in held), key=lambda x: -len(x[1]))
            sizes = np.array([len(x[1]) for x in held])
            b = np.zeros((len(held), sizes[0], n))
            for i, (_, _, own) in enumerate(held):
                b[i, : sizes[i]] = own
            state = np.stack([carried[v][0] if v in carried else model.start() for v, _, _ in held])
            first = np.array([v not in carried for v, _, _ in held])
            out = {name: np.zeros((*b.shape[:2], *more)) for name, more in (("filtered", (n,)), ("next", (n,)), ("leave", ()), ("age", ()), ("young", ()), ("young_k", ()))}
            ages = np.arange(1, model.pmf.shape[1] + 1)
            last = np.empty_like(state)
            for t, at in enumerate(filtered(model, b, state, first)):
                out["filtered"][:, t] = at.sum(axis=2)
                after = model.ahead(at).sum(axis=2)
                total = after.sum(axis=1, keepdims=True)
                out["next"][:, t] = np.where(total > 0, after / np.where(total > 0, total, 1.0), model.rest.sum(axis=1))
                out["leave"][:, t] = (at * model.hazard).sum(axis=(1, 2))
                out["age"][:, t] = (at.sum(axis=1) * ages).sum(axis=1)
                out["young"][:, t], out["young_k"][:, t] = at[:, :, 0].sum(axis=1), at[:, :, :k].sum(axis=(1, 2))
                ended = sizes == t + 1
                last[ended] = at[ended]
            for i, (video, frame, _) in enumerate(held):
                size = sizes[i]
                before = carried[video][1] if video in carried else np.zeros(0, np.int64)
                frames = np.concatenate([before, frame])
                change = []
                for name, lag in (("young", 1), ("young_k", k)):
                    there = np.concatenate([np.zeros(min(lag, len(frames)), bool), frames[lag:] - frames[:-lag] == lag])[len(before) :]
                    change.append(np.where(there, out[name][i, :size], rate))
                carried[video] = (last[i], frames[-k:])
                p, after = out["filtered"][i, :size], out["next"][i, :size]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * n, pa.int32()), pa.array(x.ravel())) for x in (p, after)]
                cols = [pa.array(np.full(size, video, np.int64)), pa.array(frame), lists[0], pa.array(p.argmax(axis=1)), lists[1], pa.array(after.argmax(axis=1)), *[pa.array(x) for x in (out["leave"][i, :size], out["age"][i, :size], *change)]]
                yield pa.record_batch(cols, names=[x.split()[0] for x in DECODED.split(", ")])

        held: list[tuple[int, list, list]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            video, frame = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(video), n)
            cuts = np.flatnonzero(np.concatenate(([True], video[1:] != video[:-1], [True])))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if not held or held[-1][0] != video[x]:
                    held.append((int(video[x]), [], []))
                held[-1][1].append(frame[x:y])
                held[-1][2].append(b[x:y])
                rows += y - x
                if rows >= ROWS or len(held) * model.pmf.size > 1 << 21:
                    yield from judged(held)
                    goes_on = held[-1][0]
                    for v in [v for v in carried if v != goes_on]:
                        del carried[v]
                    held, rows = [], 0
        if held:
            yield from judged(held)

    return run


def decode(series: DataFrame, model: Model, k: int = 3, rate: float = 0.2) -> DataFrame:
    """From (video, frame, emission): filtered (array), state, next_phase (array: of the next row), next_state, leave, age, change_prob, change_k of every row.

    A state is phase and age. The hazard of leaving depends on the age, so the next row's phases do too. As no phase follows itself, the phase k frames
    before differs exactly if the age is k or less: `change_k`, and `change_prob` for one frame; where that frame is not in the series with all between, `rate`.
    `age` is the expected age, `leave` the probability that a segment ends here. If no state explains a row, as in a last phase beyond the longest age, the phases that lead
    nowhere are taken for it, at their last age. Frames of a video must differ.

    Videos are sorted within partitions and step together as one array of some 32,000 rows; a longer video goes on from its last state, so no task holds one.
    """
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = series.select(F.col("video").cast("long"), F.col("frame").cast("long"), "emission").repartition(n, "video").sortWithinPartitions("video", "frame")
    return rows.mapInArrow(_decoded(model, k, rate), DECODED)


def chain(runs: DataFrame, durations: DataFrame, lead: DataFrame) -> DataFrame:
    """video, seg_no, phase, duration, duration_p, next_phases (phase: probability, those above 0): how likely each observed segment's duration is and where it may lead.

    Of tables of durations (phase, d, p) and steps (a, b, p), which are of fixed size; a duration beyond the table's last counts as the last.
    """
    longest = durations.groupBy("phase").agg(F.max("d").alias("longest"))
    onward = lead.filter("p > 0").groupBy(F.col("a").alias("phase")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "p")))).alias("next_phases"))
    rows = runs.select("video", "seg_no", "phase", "duration").join(F.broadcast(longest), "phase", "left").withColumn("d", F.least("duration", "longest"))
    rows = rows.join(F.broadcast(durations.select("phase", "d", F.col("p").alias("duration_p"))), ["phase", "d"], "left").join(F.broadcast(onward), "phase", "left")
    return rows.select("video", "seg_no", "phase", "duration", "duration_p", F.coalesce("next_phases", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>"))).alias("next_phases"))


def bucket_emissions(train: DataFrame, asked: DataFrame, bucket, epsilon: float = 1.0, n: int = N_PHASES, levels: int = 10) -> DataFrame:
    """`asked` with emission: logs of how often each phase of `train` shows the row's bucket (0 .. levels - 1), each count with epsilon added; zeros for other buckets."""
    known = train.select("phase", bucket.cast("int").alias("bucket")).filter("bucket >= 0").groupBy("phase", "bucket").count()
    spark = train.sparkSession
    grid = spark.range(n * levels).select(F.floor(F.col("id") / levels).alias("phase"), (F.col("id") % levels).cast("int").alias("bucket"))
    seen = grid.join(F.broadcast(known), ["phase", "bucket"], "left").na.fill(0, ["count"])
    p = (F.col("count") + epsilon) / (F.sum("count").over(W.partitionBy("phase")) + levels * epsilon)
    table = seen.select("phase", "bucket", F.ln(p).alias("p")).groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("phase", "p"))), lambda x: x["p"]).alias("emission"))
    rows = asked.withColumn("bucket", bucket.cast("int")).join(F.broadcast(table), "bucket", "left")
    return rows.withColumn("emission", F.coalesce("emission", F.array(*[F.lit(0.0)] * n))).drop("bucket")


