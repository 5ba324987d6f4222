"""Hidden-Markov recursions over blocks of frames: blocks in parallel by transfer matrices, then each block replayed from the vectors at its ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.operators.hmm import NEVER, _logsumexp

#: Rows, and blocks, that a task holds at once; they step together as one array.
ROWS, BLOCKS = 1 << 15, 512
#: Logs that lie further apart than this are not added as numbers.
WIDEST = 600.0

DECODED = "video long, frame long, filtered array<double>, log_norm double, state long, smoothed_state long, entropy double, next_state long, change_prob double, change_k double"


def blocks(series: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """video, block, own, frame, emission: frames dealt to blocks of `size` frame numbers; a block also gets the `halo` frames before it, not its own."""
    block = F.floor(F.col("frame") / size)
    rows = series.select("video", "frame", "emission", block.alias("block"))
    at = F.array(F.struct(F.col("block").alias("block"), F.lit(True).alias("own")))
    if halo:
        after = F.floor((F.col("frame") + halo) / size)
        at = F.when(after > block, F.concat(at, F.array(F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))).otherwise(at)
    return rows.select("video", "frame", "emission", F.explode(at).alias("at")).select("video", "at.block", "at.own", "frame", "emission")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Blocks of sorted rows (video, block, own, frame, emission), some at a time; a row with null `own` brings the block's vectors, in `emission`."""
    held: list[dict] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        video, block, frame = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        own = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        ends = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        width = np.diff(batch.column(4).offsets.to_numpy())
        flat, at = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(width)))
        cuts = np.flatnonzero(np.concatenate(([True], (video[1:] != video[:-1]) | (block[1:] != block[:-1]), [True])))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if not held or (held[-1]["video"], held[-1]["block"]) != (video[x], block[x]):
                if rows >= ROWS or len(held) >= BLOCKS:
                    yield held
                    held, rows = [], 0
                held.append({"video": video[x], "block": block[x], "frame": [], "own": [], "b": [], "ends": None})
            if ends[x]:
                held[-1]["ends"] = flat[at[x] : at[x + 1]]
                x += 1
            if y > x:
                held[-1]["frame"].append(frame[x:y].astype(np.int64))
                held[-1]["own"].append(own[x:y])
                held[-1]["b"].append(flat[at[x] : at[y]].reshape(y - x, -1))
                rows += y - x
    if held:
        yield held


def _stacked(group: list[dict]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """The blocks that have rows, longest first, their emissions as one array (block, step, phase) and their lengths."""
    full = [g for g in group if g["b"]]
    for g in full:
        for name in ("frame", "own", "b"):
            g[name] = np.concatenate(g[name]) if isinstance(g[name], list) else g[name]
    full.sort(key=lambda g: -len(g["b"]))
    sizes = np.array([len(g["b"]) for g in full], int)
    b = np.zeros((len(full), int(sizes[0]), full[0]["b"].shape[1])) if full else np.zeros((0, 0, 0))
    for i, g in enumerate(full):
        b[i, : sizes[i]] = g["b"]
    return full, b, sizes


def augmented(log_pi: np.ndarray, log_a: np.ndarray) -> np.ndarray:
    """Transitions with a start state in front, which is left at the first row and never entered: so every block has the same form."""
    n = len(log_pi)
    out = np.full((n + 1, n + 1), NEVER)
    out[0, 1:], out[1:, 1:] = log_pi, log_a
    return out


def step(x: np.ndarray, log_a: np.ndarray, largest: bool = False) -> np.ndarray:
    """One transition of vectors of logs (..., from) to (..., to); with `largest` the best predecessor counts, not their sum."""
    if largest:
        return (x[..., :, None] + log_a).max(axis=-2)
    # As a product of matrices where all that counts is within the range of doubles, else by logs. What is as good as never is left at that.
    top = x.max(axis=-1, keepdims=True)
    low = np.where(x > NEVER / 2, x, top).min(axis=-1, keepdims=True)
    with np.errstate(divide="ignore"):
        sums = np.log(np.exp(x - top) @ np.exp(log_a))
    out = np.where(np.isneginf(sums), NEVER, sums) + top
    wide = (top - low)[..., 0] - np.where(log_a > NEVER / 2, log_a, 0.0).min() > WIDEST
    if wide.any():
        out[wide] = _logsumexp(x[wide][..., :, None] + log_a, axis=-2)
    return out


def transfers(log_a: np.ndarray, b: np.ndarray, largest: bool) -> np.ndarray:
    """(block, from, to): logs of what any state before a block contributes to each state at its end, over rows (block, step, phase) of one length."""
    out = np.where(np.eye(len(log_a), dtype=bool), 0.0, NEVER)[None].repeat(len(b), axis=0)
    for t in range(b.shape[1]):
        out[..., 1:] = step(out, log_a, largest)[..., 1:] + b[:, None, t]
        out[..., 0] = NEVER
    return out


def _transfer_rows(log_a: np.ndarray, largest: bool, halo: int, size: int):
    """Blocks to rows (video, block, main, tail): the transfer matrices of their rows but the last `halo` frames, and of these."""
    n = len(log_a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            full, b, sizes = _stacked(group)
            cut = np.array([int(np.searchsorted(g["frame"], (g["block"] + 1) * size - halo)) for g in full], int)
            sides = []
            for low, high in ((np.zeros(len(full), int), cut), (cut, sizes)):
                side = np.empty((len(full), n, n))
                for length in np.unique(high - low):
                    own = np.flatnonzero(high - low == length)
                    for part in np.array_split(own, -(-len(own) // 64)):
                        rows = np.stack([b[i, low[i] : high[i]] for i in part]) if length else np.zeros((len(part), 0, n - 1))
                        side[part] = transfers(log_a, rows, largest)
                sides.append(side)
            cols = [pa.array([g[k] for g in full], pa.int64()) for k in ("video", "block")]
            yield pa.record_batch([*cols, *[pa.array([m.ravel() for m in s], pa.list_(pa.float64())) for s in sides]], names=["video", "block", "main", "tail"])

    return run


def _ends(n: int, halo: bool, largest: bool):
    """A video's transfer rows, in order, to rows (video, block, ends): the vector before a block's first row (before its halo, if it has one) and the one that looks back from behind its last."""

    def run(key, rows):
        rows = rows.sort_values("block")
        block = rows["block"].to_numpy()
        main, tail = (np.stack(rows[c].to_numpy()).reshape(-1, n, n) for c in ("main", "tail"))
        before, after = np.full((len(block), n), NEVER), np.zeros((len(block), n))
        x, early = np.where(np.arange(n) == 0, 0.0, NEVER), None
        for i in range(len(block)):
            close = halo and i > 0 and block[i] == block[i - 1] + 1
            before[i] = early if close else x
            early = step(x, main[i], largest)
            x = step(early, tail[i], largest)
            early, x = (v - (v.max() if largest else _logsumexp(v)) for v in (early, x))
        back = np.zeros(n)
        for i in range(len(block) - 1, -1, -1):
            after[i] = back
            back = _logsumexp(main[i] + _logsumexp(tail[i] + back, axis=1), axis=1)
            back = back - back.max()
        return rows.assign(ends=list(np.concatenate([before, after], axis=1)))[["video", "block", "ends"]]

    return run


def _with_ends(rows: DataFrame, log_pi: np.ndarray, log_a: np.ndarray, size: int, halo: int, largest: bool, partitions: int) -> DataFrame:
    """Blocks' rows, sorted, each block led by a row with the vectors at its ends; only videos of several blocks go through transfer matrices."""
    span = rows.filter("own").groupBy("video").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("high > low")
    if not span.isEmpty():
        aug = augmented(log_pi, log_a)
        several = rows.filter("own").join(span.select("video"), "video", "left_semi").repartition(partitions, "video", "block").sortWithinPartitions("video", "block", "frame")
        moved = several.mapInArrow(_transfer_rows(aug, largest, halo, size), "video long, block long, main array<double>, tail array<double>")
        ends = moved.groupBy("video").applyInPandas(_ends(len(aug), halo > 0, largest), "video long, block long, ends array<double>")
        rows = rows.unionByName(ends.select("video", "block", F.lit(None).cast("boolean").alias("own"), F.lit(None).cast("long").alias("frame"), F.col("ends").alias("emission")))
    return rows.repartition(partitions, "video", "block").sortWithinPartitions("video", "block", F.asc_nulls_first("frame"))


def _starts(full: list[dict], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors before each block (with the start state) and behind it; a block that is its video has those of a video's ends."""
    before, after = np.full((len(full), n + 1), NEVER), np.zeros((len(full), n))
    before[:, 0] = 0.0
    for i, g in enumerate(full):
        if g["ends"] is not None:
            before[i], after[i] = g["ends"][: n + 1], g["ends"][n + 2 :]
    return before, after


def replayed(log_pi: np.ndarray, log_a: np.ndarray, b: np.ndarray, sizes: np.ndarray, before: np.ndarray, after: np.ndarray, k: int, smooth: bool) -> dict[str, np.ndarray]:
    """Over blocks (block, step, phase): log posteriors, their normalisers, smoothed ones, and the chance that the phase is not that of 1 and of k rows before (nan where nothing explains the rows between)."""
    aug, (count, length, n) = augmented(log_pi, log_a), b.shape
    own, norm = np.zeros(b.shape), np.zeros((count, length))
    x = before
    for t in range(length):
        live = int(np.searchsorted(-sizes, -t, "left"))  # blocks are sorted: these have a row t
        new = step(x[:live], aug)[:, 1:] + b[:live, t]
        norm[:live, t] = _logsumexp(new)
        own[:live, t] = new - norm[:live, t, None]
        x = np.concatenate([np.full((live, 1), NEVER), own[:live, t]], axis=1)
    out = {"own": own, "norm": norm}
    if smooth:
        both = np.zeros(b.shape)
        for t in range(length - 1, -1, -1):
            last = sizes == t + 1
            back = np.where(last[:, None], after, 0.0) if t == length - 1 else np.where(last[:, None], after, step(b[:, t + 1] + back, log_a.T))
            both[:, t] = own[:, t] + back
        out["smoothed"] = both
    seen, onward = np.exp(b - b.max(axis=2, keepdims=True)), np.exp(log_a)
    for name, lag in (("change_1", 1), ("change_k", k)):
        change = np.full((count, length), np.nan)
        if length > lag:
            if lag == 1 or not np.tril(onward, -1).any():  # who leaves a phase does not come back, so only who stayed is in the same one
                every = np.exp(own[:, :-lag])  # block, row, phase
                stayed = every
                for s in range(1, lag + 1):
                    at = seen[:, s : length - lag + s]
                    stayed, every = stayed * np.diagonal(onward) * at, (every.reshape(-1, n) @ onward).reshape(every.shape) * at
                    total = every.sum(axis=2, keepdims=True)
                    total = np.where(total > 0, total, np.nan)
                    stayed, every = stayed / total, every / total
                same = stayed.sum(axis=2)
            else:
                paths = np.exp(own[:, :-lag, :, None]) * np.eye(n)  # block, row, phase at t - lag, phase now
                for s in range(1, lag + 1):
                    paths = (paths @ onward) * seen[:, s : length - lag + s, None, :]
                    total = paths.sum(axis=(2, 3), keepdims=True)
                    paths = paths / np.where(total > 0, total, np.nan)
                same = np.trace(paths, axis1=2, axis2=3)
            change[:, lag:] = np.clip(1 - same, 0.0, 1.0)
        out[name] = change
    return out


def _decoded(log_pi: np.ndarray, log_a: np.ndarray, k: int, rate: float, smooth: bool):
    n, onward = len(log_pi), np.exp(log_a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            full, b, sizes = _stacked(group)
            if not full:
                continue
            found = replayed(log_pi, log_a, b, sizes, *_starts(full, n), k, smooth)
            for i, g in enumerate(full):
                size, frame, own = sizes[i], g["frame"], g["own"]
                p = np.exp(found["own"][i, :size])
                change = []
                for name, lag in (("change_1", 1), ("change_k", k)):
                    there = np.concatenate([np.zeros(min(lag, size), bool), frame[lag:] - frame[:-lag] == lag])
                    value = found[name][i, :size]
                    change.append(np.where(there & ~np.isnan(value), value, rate)[own])
                entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
                smoothed = pa.array(found["smoothed"][i, :size].argmax(axis=1)[own], pa.int64()) if smooth else pa.nulls(int(own.sum()), pa.int64())
                filtered = pa.ListArray.from_arrays(pa.array(np.arange(int(own.sum()) + 1) * n, pa.int32()), pa.array(p[own].ravel()))
                cols = [np.full(int(own.sum()), g["video"], np.int64), frame[own], filtered, found["norm"][i, :size][own], p.argmax(axis=1)[own], smoothed, entropy[own], (p @ onward).argmax(axis=1)[own], *change]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in DECODED.split(", ")])

    return run


def decode(series: DataFrame, log_pi: np.ndarray, log_a: np.ndarray, k: int = 3, rate: float = 0.2, size: int = 1024, smooth: bool = True) -> DataFrame:
    """From (video, frame, emission): filtered (array), log_norm, state, smoothed_state, entropy, next_state, change_prob, change_k of every row.

    `log_norm` is the log of the row's probability given the rows before; a video's sum is its log-likelihood. The changes compare with the row at exactly
    1 and k frames before, with all frames between in the series; elsewhere they are `rate`. Frames of a video must differ; its rows may have gaps.

    No task holds a video: blocks of `size` frame numbers, each with the k frames before it, are rows of one group. Where videos have several blocks, each
    block's transfer matrix over a start state and the phases is made in parallel, a video's few matrices are applied to its first vector from the left and to
    its last from the right, and every block is replayed from these. Blocks of about 32,000 rows step together as one array.
    """
    if k >= size:
        raise ValueError("blocks must be longer than k")
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _with_ends(blocks(series, size, k), log_pi, log_a, size, k, False, n)
    return rows.mapInArrow(_decoded(log_pi, log_a, k, rate, smooth), DECODED)


def log_likelihoods(decoded: DataFrame) -> DataFrame:
    """video, n, log_likelihood, per_frame of decoded rows."""
    return decoded.groupBy("video").agg(F.count("*").alias("n"), F.sum("log_norm").alias("log_likelihood"), F.avg("log_norm").alias("per_frame"))


def _pointers(log_a: np.ndarray, log_pi: np.ndarray, b: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, step, phase) best predecessors, -1 before a video's first row, and the scores at each block's end."""
    came, score, final = np.zeros(b.shape, np.int16), before[:, 1:], np.zeros((len(b), b.shape[2]))
    begins = before[:, 0] > NEVER / 2
    for t in range(b.shape[1]):
        live = int(np.searchsorted(-sizes, -t, "left"))
        each = score[:live, :, None] + log_a
        came[:live, t], new = each.argmax(axis=1), each.max(axis=1)
        if t == 0:
            came[begins, t], new[begins] = -1, log_pi
        new = new + b[:live, t]
        new = new - new.max(axis=1, keepdims=True)
        ended = sizes[:live] == t + 1
        final[:live][ended] = new[ended]
        score = new
    return came, final


def _walk(came: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For phases at a block's end, (step, phase) paths to it and the phase before its first row."""
    path = np.empty((len(came), len(state)), np.int64)
    for t in range(len(came) - 1, -1, -1):
        path[t] = state
        state = came[t, state]
    return path, state


def _maps(log_pi: np.ndarray, log_a: np.ndarray, last: bool):
    """Blocks to rows (video, block, entry, best, ends): for each phase at a block's end, the phase before its first row on the best way; or, with the phase at its end known, the path."""
    n = len(log_pi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            full, b, sizes = _stacked(group)
            if not full:
                continue
            before = np.full((len(full), n + 1), NEVER)
            before[:, 0] = 0.0
            for i, g in enumerate(full):
                if g["ends"] is not None:
                    before[i] = g["ends"][: n + 1]
            came, final = _pointers(log_a, log_pi, b, sizes, before)
            for i, g in enumerate(full):
                size, best = int(sizes[i]), int(final[i].argmax())
                if last:
                    state = best if g["ends"] is None else int(g["ends"][-1])
                    path, _ = _walk(came[i, :size], np.array([state]))
                    yield pa.record_batch([pa.array(np.full(size, g["video"], np.int64)), pa.array(g["frame"]), pa.array(path[:, 0])], names=["video", "frame", "viterbi_state"])
                elif g["ends"] is not None:
                    _, entry = _walk(came[i, :size], np.arange(n))
                    cols = [pa.array([g["video"]], pa.int64()), pa.array([g["block"]], pa.int64()), pa.array([entry.tolist()], pa.list_(pa.int64())), pa.array([best], pa.int64()), pa.array([g["ends"].tolist()], pa.list_(pa.float64()))]
                    yield pa.record_batch(cols, names=["video", "block", "entry", "best", "ends"])

    return run


def _chain(key, rows):
    """A video's maps to the phase at each block's end, from the last block to the first; it goes behind the block's vectors."""
    rows = rows.sort_values("block")
    state, ends = None, []
    for entry, best in zip(rows["entry"][::-1], rows["best"][::-1], strict=True):
        state = int(best) if state is None else state
        ends.append(state)
        state = int(entry[state])
    return rows.assign(ends=[np.append(v, float(s)) for v, s in zip(rows["ends"], reversed(ends), strict=True)])[["video", "block", "ends"]]


def best_paths(series: DataFrame, log_pi: np.ndarray, log_a: np.ndarray, size: int = 1024) -> DataFrame:
    """video, frame, viterbi_state: the likeliest path of each video; the lowest phase wins ties, as it does row by row.

    As in `decode`, but with largest instead of summed contributions. A block tells, for each phase at its end, the phase before it; a video's chain of these from
    the last block back fixes the phase at each block's end, and blocks are walked once more from there.
    """
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = blocks(series, size)
    rows = _with_ends(plain, log_pi, log_a, size, 0, True, n)
    maps = rows.mapInArrow(_maps(log_pi, log_a, False), "video long, block long, entry array<long>, best long, ends array<double>")
    ends = maps.groupBy("video").applyInPandas(_chain, "video long, block long, ends array<double>")
    both = plain.unionByName(ends.select("video", "block", F.lit(None).cast("boolean").alias("own"), F.lit(None).cast("long").alias("frame"), F.col("ends").alias("emission")))
    both = both.repartition(n, "video", "block").sortWithinPartitions("video", "block", F.asc_nulls_first("frame"))
    return both.mapInArrow(_maps(log_pi, log_a, True), "video long, frame long, viterbi_state long")


