"""Packing documents into training sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.textscan import column_slices
from phaseloom.llm.tokens import ENCODED, encoder, vocabulary

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by the largest differencing method for `windows` parts.

    Every size starts as a partial partition with one filled part. The two partial partitions of largest imbalance are merged
    so that full parts of one meet empty parts of the other, until one is left; each merge keeps the order it used, and going
    back through the merges tells every size its window.
    """
    n = len(sizes)
    if windows == 1 or n <= 1:
        return np.zeros(n, np.int64)
    sums = np.zeros((n, windows), np.int64)
    sums[:, 0] = sizes
    rows = list(sums)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = rows[a] + rows[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        rows[a] = rows[b] = None
        rows.append(both)
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), len(rows) - 1))
    places: dict[int, np.ndarray] = {len(rows) - 1: np.arange(windows)}
    out = np.empty(n, np.int64)
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        here = np.empty(windows, np.int64)
        here[order] = places.pop(n + k)
        for child, own in ((a, here), (b, here[::-1])):
            if child < n:
                out[child] = own[0]
            else:
                places[child] = own
    return out


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none above `capacity`: near-equal windows, one more each time that a window overflows."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        out = differencing(sizes, windows)
        if np.bincount(out, sizes, minlength=1).max(initial=0) <= capacity:
            return out
        windows += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = 2048, piece: int = 512, group_windows: int = 96, group_pieces: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of documents placed in sequences of at most `capacity` tokens.

    One row for each piece: doc_id, start (the document's tokens before it), length, doc_tokens (with the end token),
    sequence_id, offset (in the sequence, gapless from 0) and ids (little-endian unsigned 32-bit tokens). Tokens are the
    vocabulary's ids without special tokens, then `end_id`. Null or empty texts give one piece that holds the end token. Rows that
    share an id are documents of their own; a null id stays null. An empty table gives no rows.

    Whole sequences are cut off long documents. What is left of each document, in parts of at most `piece` tokens, is packed
    in groups of about `group_windows` sequences (`group_pieces` parts at most) by differencing; groups never leave the task that read the documents, so nothing
    is shuffled and memory holds one group. Sequence ids combine the task's partition and a counter.
    """
    path = tokenizer_path or vocabulary()
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        base = TaskContext.get().partitionId() << 40
        made = 0
        rows: list[tuple] = []  # id, start, length, tokens, sequence, offset, ids
        open_: list[tuple] = []  # id, start, length, tokens, ids
        held = 0

        def close() -> None:
            nonlocal made, held
            windows = fill(np.array([x[2] for x in open_], np.int64), capacity)
            filled = [0] * (int(windows.max()) + 1)
            for x, w in zip(open_, windows.tolist(), strict=True):
                rows.append((*x[:4], base + made + w, filled[w], x[4]))
                filled[w] += x[2]
            made += len(filled)
            held = 0
            open_.clear()

        def packed_texts(part: pa.Array) -> Iterator[bytes]:
            ids, bounds = enc.ids(part)
            return (ids[a:b].tobytes() for a, b in itertools.pairwise(bounds.tolist()))

        def out() -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [pa.binary()]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            return batch

        for batch in batches:
            encoded = (ids for *_, part in column_slices(batch.column(1), ENCODED) for ids in packed_texts(part))
            for key, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += tail
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    rows.append((key, start, capacity, n, base + made, 0, ids[4 * start : 4 * (start + capacity)]))
                    made += 1
                parts = -(-(n - whole) // piece)
                for k in range(parts):
                    start, end = (whole + (n - whole) * j // parts for j in (k, k + 1))
                    open_.append((key, start, end - start, n, ids[4 * start : 4 * end]))
                held += n - whole
                if held >= group_windows * capacity or len(open_) >= group_pieces:
                    close()
                if len(rows) >= 1024:
                    yield out()
        if open_:
            close()
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCHEMA)
