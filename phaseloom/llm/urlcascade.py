"""URL filters by a cascade of Bloom filters: exact membership of listed keys over all keys that a table of URLs can ask for."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed
from phaseloom.llm.textscan import mix

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words, and how many positions a key has."""

    words: np.ndarray
    hashes: int


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    """The bit positions of each key in a level: a (hashes, keys) array."""
    salt = np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    a, b = mix(h1.view(np.uint64) + salt), mix(h2.view(np.uint64) ^ salt) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(hashes)])


def _passes(h1: np.ndarray, h2: np.ndarray, number: int, level: Level) -> np.ndarray:
    at = _positions(h1, h2, number, 64 * len(level.words), level.hashes)
    return ((level.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def is_listed(h1: np.ndarray, h2: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Whether each key is listed: the first level that a key does not pass decides; keys that pass all belong to the last."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    left = np.arange(len(h1))
    for number, level in enumerate(levels):
        ok = _passes(h1[left], h2[left], number, level)
        out[left[~ok]] = number % 2 == 1
        left = left[ok]
    return out


def _filter(keys: DataFrame, number: int, count: int, rate: float, most_bytes: int) -> Level:
    """A Bloom filter over the keys (h1, h2): tasks emit the words that their keys set, words are or-ed where they meet."""
    size = 64 * max(1, math.ceil(count * math.log2(1 / rate) / math.log(2) / 64))
    if size // 8 > most_bytes:
        raise ValueError(f"a level needs {size // 8} bytes, over the bound of {most_bytes}; split the list by key")
    hashes = max(1, round(math.log2(1 / rate)))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            at = np.unique(_positions(h1, h2, number, size, hashes))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            own = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(own.view(np.int64))], names=["word", "bits"])

    rows = keys.select("h1", "h2").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(size // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return Level(words.view(np.uint64), hashes)


def build_cascade(universe: DataFrame, most_bytes: int = 64 << 20) -> list[Level]:
    """Levels that tell the listed keys of `universe` (h1, h2, listed; distinct keys) from all its others, without error.

    Level 1 encodes the listed keys, level 2 the other keys that level 1 lets pass, level 3 the listed keys that level 2 lets
    pass, and so on until nothing passes wrongly. A level's size is known before it is built and is
    refused above `most_bytes`; the table's rows stay on the executors. No listed key gives no level.
    """
    spark = universe.sparkSession
    inside, outside = universe.filter("listed"), universe.filter("not listed")
    count, others = inside.count(), outside.count()
    levels: list[Level] = []
    while count:
        rate = 0.5 if levels else min(0.5, math.sqrt(0.5) * count / max(1, others))
        number = len(levels)
        level = _filter(inside, number, count, rate, most_bytes)
        levels.append(level)
        shared = spark.sparkContext.broadcast(level)

        def wrong(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h1, h2 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
                yield batch.filter(pa.array(_passes(h1, h2, number, shared.value)))

        passed = checkpointed(outside.select("h1", "h2").mapInArrow(wrong, "h1 long, h2 long"))
        inside, outside, count, others = passed, inside, passed.count(), count
    return levels


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("cascade"), key)


def candidate_keys(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """The rule strings that could fit a URL, longest first: its last labels, for each depth, before its path's beginnings."""
    labels = F.split(host, "\\.")
    tails = [F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), ".")) for d in depths]
    heads = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    keys = F.array_compact(F.array(*[F.concat(t, h) for t in tails for h in heads]))
    return F.array_sort(F.array_distinct(keys), lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", most_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, by rules (action, host and path).

    A rule like `example.org/es/` fits its host and all subdomains if the path begins with the rule's; the longest that fits
    gives its action. Where none fits, no listed key was found: rule is null and the verdict `allow`, as for any URL that a list does
    not name. Null URLs and URLs without `://` have empty host and path. Repeated rows are judged alike, null ids stay; an empty table
    gives no rows. Other columns are ignored.

    The keys that a URL can ask for are its host's endings joined with its path's beginnings, of the lengths that
    rules have. The distinct ones of the whole table are the universe over which two cascades are built: one tells which keys are
    rules, one which rules block. Rows then find their rule by probing alone; nothing is joined with the list.
    """
    spark = pages.sparkSession
    split = [(action, rule[: (rule + "/").index("/")], rule) for action, rule in rules]
    depths = sorted({h.count(".") + 1 for _, h, _ in split})
    lengths = sorted({len(r) - len(h) for _, h, r in split})
    host, path = host_and_path(F.col(url_col).cast("string"))
    asked = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    asked = asked.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), depths, lengths) if rules else F.array().cast("array<string>"))
    listed = F.col("key").isin([r for _, _, r in split])
    blocks = F.col("key").isin([r for a, _, r in split if a == BLOCK])
    universe = asked.select(F.explode("keys").alias("key")).distinct()
    h1, h2 = _hashes(F.col("key"))
    universe = checkpointed(universe.select(h1.alias("h1"), h2.alias("h2"), listed.alias("listed"), blocks.alias("blocks")))
    named = build_cascade(universe.select("h1", "h2", "listed"), most_bytes)
    blocking = build_cascade(universe.filter("listed").select("h1", "h2", F.col("blocks").alias("listed")), most_bytes)
    shared = spark.sparkContext.broadcast((named, blocking))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bad = shared.value
        for batch in batches:
            n = batch.num_rows
            lists, a, b = batch.column(3), batch.column(4).flatten(), batch.column(5).flatten()
            a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(n), sizes)
            hit = np.flatnonzero(is_listed(a, b, known))
            first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]  # keys come longest first
            at = np.full(n, -1)
            at[row[first]] = first
            blocked = np.zeros(n, bool)
            blocked[row[first]] = is_listed(a[first], b[first], bad)
            rule = lists.flatten().take(pa.array(np.maximum(at, 0), mask=at < 0))
            verdict = pa.array(np.where(blocked, BLOCK, ALLOW), pa.string())
            yield pa.record_batch([*batch.columns[:3], rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[id_col]
    probed = asked.withColumn("h1", F.transform("keys", lambda k: _hashes(k)[0])).withColumn("h2", F.transform("keys", lambda k: _hashes(k)[1]))
    return probed.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
