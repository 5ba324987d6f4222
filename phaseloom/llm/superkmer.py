"""Substring deduplication by super-k-mers: repeated windows of words are found exactly and their later occurrences removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import partitions
from phaseloom.llm.textscan import CHUNK, Words, lean_worker, mix, packed, same_bytes, sliding_min, span_hash, text_slices, unpacked, xxh64_of_longs

NULL_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,length:int>>, row "


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def cut_super_kmers(words: Words, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and minimiser of each run of consecutive windows of one text that share a minimiser."""
    none = np.zeros(0, np.int64)
    if len(words.starts) < window:
        return none, none, none.astype(np.uint64)
    own = words.hashes()
    grams = own[: len(own) - minimiser + 1].copy()
    for k in range(1, minimiser):
        grams = mix(grams * np.uint64(31) + own[k : len(own) - minimiser + 1 + k])
    least = sliding_min(grams, window - minimiser + 1)
    last = np.repeat(np.cumsum(words.counts), words.counts)[: len(least)]  # end of the text that holds each word
    valid = np.arange(len(least)) + window <= last
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & fresh)
    ends = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
    return first, ends + window - 1, least[first]


def _super_kmers(texts: list[bytes], ids: np.ndarray, window: int, minimiser: int, buckets: int) -> list[tuple]:
    """(bucket, documents, starts, lengths, strings) of the super-k-mers of some texts, equal ones once, by bucket."""
    words = Words(texts)
    first, last, least = cut_super_kmers(words, window, minimiser)
    if not len(first):
        return []
    begins = np.cumsum(words.counts) - words.counts
    text = np.searchsorted(begins, first, "right") - 1
    doc, start = ids[text], (first - begins[text]).astype(np.int32)
    a, b = words.starts[first], words.ends[last] + 1  # with the blank behind the last word
    print_ = span_hash(words.data, a, b)
    order = np.lexsort((start, doc, print_))
    same = np.zeros(len(order), bool)
    same[1:] = print_[order[1:]] == print_[order[:-1]]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))][same]
    twin = order[same]
    alike = (b - a)[head] == (b - a)[twin]
    alike[alike] = same_bytes(words.data, a[head[alike]], a[twin[alike]], (b - a)[twin[alike]])
    keep = np.ones(len(order), bool)
    keep[twin[alike]] = False  # an equal super-k-mer starts earlier in these texts: all its windows do
    keep = np.flatnonzero(keep)
    bucket = (mix(least[keep]) % np.uint64(buckets)).astype(np.int64)
    keep, bucket = keep[np.argsort(bucket, kind="stable")], np.sort(bucket)
    raw = words.data.tobytes()
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
    out = []
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = keep[x:y]
        strings = b"".join([raw[p:q] for p, q in zip(a[own].tolist(), b[own].tolist(), strict=True)])
        out.append((int(bucket[x]), doc[own], start[own], (b - a)[own].astype(np.int32), strings))
    return out


def _route(window: int, minimiser: int, buckets: int, flush: int):
    """Texts to rows (bucket, blob): super-k-mers are cut a chunk of text at a time and packed by bucket every `flush` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            names = sorted(held)
            rows = []
            for name in names:
                doc, start, lengths, strings = zip(*held.pop(name), strict=True)
                rows.append(packed(3, np.concatenate(doc), np.concatenate(start), np.concatenate(lengths), np.frombuffer(b"".join(strings), np.uint8)))
            size = 0
            return pa.record_batch([pa.array(names, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "blob"])

        with lean_worker():
            for batch in batches:
                ids = _ids(batch.column(0))
                for i, j, texts in text_slices(batch.column(1)):
                    for bucket, *parts in _super_kmers(texts, ids[i:j], window, minimiser, buckets):
                        held.setdefault(bucket, []).append(parts)
                    size += sum(map(len, texts))
                    if size >= flush and held:
                        yield out()
            if held:
                yield out()

    return run


def first_windows(doc: np.ndarray, start: np.ndarray, lengths: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (document, first word, how many) whose words start nowhere earlier, of the super-k-mers of one bucket."""
    order = np.lexsort((start, doc))
    begins = np.cumsum(lengths.astype(np.int64)) - lengths
    hashes, at, size = [], [], []
    cuts = [0]
    while cuts[-1] < len(begins):  # hash a chunk of strings at a time
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begins, begins[cuts[-1]] + CHUNK))))
    n_windows = np.zeros(len(begins), np.int64)
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = int(begins[x]), int(begins[y - 1] + lengths[y - 1])
        part = data[low:high]
        ends = np.flatnonzero(part == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        n_words = np.diff(np.searchsorted(ends, begins[x:y] + lengths[x:y] - low), prepend=0)
        n_windows[x:y] = n_words - window + 1
        last = np.repeat(np.cumsum(n_words), n_words)
        full = np.flatnonzero(np.arange(len(starts)) + window <= last)
        s, e = starts[full], ends[full + window - 1]
        hashes.append(span_hash(part, s, e))
        at.append((s + low).astype(np.int64 if len(data) >> 31 else np.int32))
        size.append((e - s).astype(np.int32))
    hashes, at, size = np.concatenate(hashes), np.concatenate(at), np.concatenate(size)
    own = np.repeat(np.arange(len(begins), dtype=np.int32), n_windows)
    offset = (np.arange(len(own)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)).astype(np.int32)
    ahead = np.concatenate(([0], np.cumsum(n_windows[order])[:-1])) - (np.cumsum(n_windows) - n_windows)[order]
    by_place = np.arange(len(own)) - np.repeat(ahead, n_windows[order])  # windows in the order in which they start in the corpus
    sort = by_place[np.argsort(hashes[by_place], kind="stable")]
    same = np.zeros(len(sort), bool)
    same[1:] = hashes[sort[1:]] == hashes[sort[:-1]]
    head = sort[np.maximum.accumulate(np.where(same, 0, np.arange(len(sort))))]
    twin, head = sort[same], head[same]
    here = (doc[own[twin]] == doc[own[head]]) & (start[own[twin]] + offset[twin] == start[own[head]] + offset[head])
    later = np.zeros(len(own), bool)
    alike = size[twin] == size[head]
    alike[alike] = same_bytes(data, at[head[alike]], at[twin[alike]], size[twin[alike]].astype(np.int64))
    if alike.all():
        later[twin[~here]] = True
    else:  # two different windows have one hash: compare the words themselves
        first: dict[bytes, tuple] = {}
        for k in by_place.tolist():
            place = (int(doc[own[k]]), int(start[own[k]] + offset[k]))
            later[k] = first.setdefault(data[at[k] : at[k] + size[k]].tobytes(), place) != place
    kept = ~later
    edge = np.ones(len(own), bool)
    edge[1:] = (own[1:] != own[:-1]) | (kept[1:] != kept[:-1])
    runs = np.flatnonzero(edge)
    many = np.diff(np.append(runs, len(own)))
    runs, many = runs[kept[runs]], many[kept[runs]]
    return doc[own[runs]], (start[own[runs]] + offset[runs]).astype(np.int32), many.astype(np.int32)


def _judge(window: int, buckets: int):
    """Buckets of super-k-mers to rows (part, blob): the runs of first windows, packed by the part that holds their document."""

    def judged(blobs: list[bytes]) -> pa.RecordBatch:
        doc, start, lengths, data = (np.concatenate(x) for x in zip(*[unpacked(x, "<i8", "<i4", "<i4", "u1") for x in blobs], strict=True))
        doc, begin, many = first_windows(doc, start, lengths, data, window)
        part = xxh64_of_longs(doc) % buckets
        order = np.lexsort((begin, doc, part))
        doc, begin, many, part = doc[order], begin[order], many[order], part[order]
        bounds = np.flatnonzero(np.diff(part, prepend=-1, append=buckets))
        rows = [packed(1, np.diff(doc[x:y], prepend=0), begin[x:y], many[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.record_batch([pa.array(part[bounds[:-1]], pa.int32()), pa.array(rows, pa.binary())], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            held: dict[int, list[bytes]] = {}
            for batch in batches:
                for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(bucket, []).append(blob)
            for bucket in sorted(held):
                yield judged(held.pop(bucket))

    return run


def _kept(text: bytes, window: int, begin: np.ndarray, many: np.ndarray, joined: bool) -> tuple[int, int, bytes, list]:
    """n_words, n_removed, the kept words and the removed runs of a text whose first windows are given as runs.

    A text that keeps all its words is joined anew only if `joined`."""
    words = text.split()
    n = len(words)
    if n < window or many.sum() == n - window + 1:
        return n, 0, b" ".join(words) if joined else text, []
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + many, -1)
    later = np.cumsum(change)[: n - window + 1] == 0
    cover = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(later)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover)[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    runs = [{"start": s, "length": e - s} for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
    return n, int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]), runs


def _apply(window: int, joined: bool):
    """A part's blobs, then its documents: each document without the words that later windows cover."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))]

    def runs_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [unpacked(x, "<i8", "<i4", "<i4") for x in blobs]
        doc = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(x[0]) for x in parts]])
        begin, many = (np.concatenate([np.zeros(0, np.int32), *[x[k] for x in parts]]) for k in (1, 2))
        order = np.argsort(doc, kind="stable")
        return doc[order], begin[order], many[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            blobs: list[bytes] = []
            runs: tuple | None = None
            for batch in batches:
                marks = batch.column(0).to_pylist()
                blobs += [x for x in marks if x is not None]
                if marks[-1] is not None:
                    continue
                if runs is None:
                    runs = runs_of(blobs)
                    blobs.clear()
                docs = batch.slice(sum(x is not None for x in marks))
                ids = _ids(docs.column(1))
                for i, j, texts in text_slices(docs.column(2)):
                    low, high = np.searchsorted(runs[0], ids[i:j], "left"), np.searchsorted(runs[0], ids[i:j], "right")
                    rows = [_kept(t, window, runs[1][x:y], runs[2][x:y], joined) for t, x, y in zip(texts, low.tolist(), high.tolist(), strict=True)]
                    cols = list(zip(*rows, strict=True))
                    part = docs.slice(i, j - i)
                    missing = [False] * (j - i) if joined else part.column(2).is_null().to_pylist()
                    cols[2] = [None if gone else x.decode("utf-8", "replace") for x, gone in zip(cols[2], missing, strict=True)]
                    yield pa.record_batch([part.column(1), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)], part.column(3)], names=["doc_id", "n_words", "n_removed", "kept_text", "removed", "row"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, minimiser: int = 3, buckets: int | None = None, flush_bytes: int = 16 << 20, carried: tuple[str, ...] = (), joined: bool = True) -> DataFrame:
    """Each document without the words that repeat a passage which starts earlier.

    A passage is `window` consecutive words of one document; a word goes if a window over it has the words of a window that
    starts earlier (smaller id, or same document and earlier start). One row for each document: doc_id, n_words, n_removed,
    kept_text (kept words joined by one blank) and removed (runs of removed words). Null and empty texts have no words; texts
    with fewer words than a window stay whole. Rows that share an id count as one place: a window at the same word of the
    same id is the same window, so repeated rows keep what the first of them keeps. A null id comes after all others. An empty
    table gives no rows. Other columns are ignored, but for those in `carried`: they come back in a struct `row`, next to the results; the text
    travels once, so it is never among them. With `joined` false, a text that keeps all its words, or is null, comes back as it was.

    Consecutive windows that share a minimiser (the least hash of `minimiser` words in them) travel as one packed string to the
    minimiser's bucket; equal strings of one batch travel once. A bucket sorts its windows by their words and sends back the runs
    of windows that nothing precedes; what no run covers is repeated, so copies of any number send nothing back. The
    documents' texts are shuffled once. Two shuffles, of `buckets` parts each (twice Spark's setting by default): windows, then documents with
    their runs.
    """
    spark = docs.sparkSession
    n = buckets or 2 * partitions(spark)
    carried = tuple(c for c in carried if c != text_col)
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None).cast("int")
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    routed = base.select("doc", "text").mapInArrow(_route(window, minimiser, n, flush_bytes), "bucket int, blob binary").repartitionById(n, F.col("bucket"))
    judged = routed.mapInArrow(_judge(window, n), "part int, blob binary")
    key = F.coalesce("doc", F.lit(int(NULL_ID)))
    part = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    both = judged.select("part", "blob", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(base.schema["row"].dataType).alias("row"))
    both = both.unionByName(base.select(part.alias("part"), F.lit(None).cast("binary").alias("blob"), "doc", "text", "row"))
    both = both.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("blob").isNull())
    out = both.select("blob", "doc", "text", "row").mapInArrow(_apply(window, joined), RESULT + base.schema["row"].dataType.simpleString())
    return out if carried else out.drop("row")
