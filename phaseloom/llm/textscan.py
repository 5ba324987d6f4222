"""Vectorised word scanning over batches of texts: spans, rolling hashes and byte comparison with numpy."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: About so many bytes of text are worked on at a time.
CHUNK = 1 << 20

#: Cached functions whose values a worker keeps between tasks.
KEPT: list[functools._lru_cache_wrapper] = []


def give_back() -> None:
    """Memory that was freed goes back to the system, where the system's library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def lean_worker() -> Iterator[None]:
    """For a task's whole run: workers are used again by tasks of other operators, so what those kept goes back to the system first, and what is free last.

    Kept values may refer to themselves, as an encoder's caches do to the encoder, so they are not free before they are collected.
    """
    if any(kept.cache_info().currsize for kept in KEPT):
        for kept in KEPT:
            kept.cache_clear()
        gc.collect()
        give_back()
    try:
        yield
    finally:
        give_back()


def chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of consecutive texts with about `most` bytes each; a longer text stands alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def column_slices(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, pa.Array]]:
    """(from, to, values) over a string column, a chunk at a time; nothing is copied."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, j in chunks(sizes, most):
        yield i, j, column.slice(i, j - i)


def text_slices(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) over a string column, a chunk at a time, so that a batch is never copied whole."""
    for i, j, part in column_slices(column, most):
        yield i, j, as_bytes(part)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: np.uint64) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    return row(_BASE), row(np.uint64(pow(int(_BASE), -1, 1 << 64)))


_kept_powers = functools.lru_cache(maxsize=1)(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64; kept for as long as chunks have their usual size."""
    up, down = _kept_powers(2 * CHUNK) if n <= 2 * CHUNK else _powers(n)
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial over the bytes, modulo 2^64, from which hashes of all byte ranges follow."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return sums


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range data[start:end], by differences of one prefix sum."""
    sums = prefix_sums(data) if sums is None else sums
    _, down = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, step: int = 4 << 20) -> np.ndarray:
    """Whether data[left:left+length] equals data[right:right+length], for each row; a few MB are compared at a time."""
    out = np.ones(len(left), bool)
    bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, "right")) - 1)
        own = lengths[i:j]
        at = np.arange(bounds[j] - bounds[i]) - np.repeat(bounds[i:j] - bounds[i], own)
        equal = data[np.repeat(left[i:j], own) + at] == data[np.repeat(right[i:j], own) + at]
        full = own > 0
        if full.any():
            out[i:j][full] = np.logical_and.reduceat(equal, (bounds[i:j] - bounds[i])[full])
        i = j
    return out


class Words:
    """The words of some texts: `data` holds them all, each followed by one blank; `starts`, `ends` bound them and `counts` tells how many each text has."""

    def __init__(self, texts: list[bytes], separator: np.ndarray = _SEPARATOR, fold: np.ndarray | None = None):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        apart = separator[raw]
        edge = np.flatnonzero(np.diff(apart, prepend=True))  # word starts and ends alternate
        starts, ends = edge[0::2], edge[1::2]
        limits = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(starts, limits), prepend=0)
        kept = ~apart
        kept[ends] = True
        data = np.where(apart, np.uint8(32), raw if fold is None else fold[raw])
        self.data = data[kept]
        self.ends = np.cumsum(ends - starts + 1) - 1
        self.starts = self.ends - (ends - starts)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def xxh64_of_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 64-bit integers, as Spark's xxhash64 gives it for one bigint column (signed)."""
    # Fixed values of the public XXH64 definition.
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    x = values.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8)
        h = h ^ (turned(x * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def packed(level: int, *arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    import zstandard

    raw = b"".join([np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes(), *[a.tobytes() for a in arrays]])
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    """The arrays of such a string, of the given types."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(types), 8)
    at = 8 * (len(types) + 1)
    out = []
    for kind, size in zip(types, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out
