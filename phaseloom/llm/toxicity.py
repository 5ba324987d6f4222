"""Toxicity by class-conditional Kneser-Ney models of word pairs, compared by length-normalised log-likelihoods."""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import checkpointed, crc_bucket, partitions
from phaseloom.llm.textscan import Words, lean_worker, mix, packed, prefix_sums, span_hash, text_slices, unpacked

_SEPARATOR = np.array([not (x >= 0x80 or chr(x).isalnum()) for x in range(256)])
_FOLD = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)
_BEGIN = np.uint64(0x5DEECE66D)  # stands for the place before a text's first word
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the beginnings that stand above a word: words share them as contexts. The first of them is the same for both classes.
BEGINNINGS = (1, 4, 6)
#: Labels are sent to every task up to so many rows; more are joined by a shuffle.
MOST_LABELS = 1_000_000
#: Bytes of text that are counted before a task sends its counts, and bytes of text for each bucket that gathers them.
FLUSH, BUCKET = 16 << 20, 32 << 20
#: Words that hold more than this share of a sample's words are dealt over all buckets by the word before; found on so many rows of each part of the table. Results do not depend on it.
COMMON, COMMON_ROWS = 1 / 2048, 64
#: Models of so many entries (16 bytes each) are sent to every task; tasks read larger ones from files of the checkpoint folder, of about so many entries each.
MOST_KEYS, PART = 4_000_000, 1_000_000
#: Kinds of a model's entries.
WORDS, PAIRS, CONTEXTS = 0, 10, 11


class Expressions:
    """The words (letters and digits, A-Z as a-z) of some texts, and hashes of them and their beginnings, made when asked for."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(texts, _SEPARATOR, _FOLD)
        self.sums = prefix_sums(self.words.data)
        self.counts = self.words.counts

    def own(self) -> np.ndarray:
        return span_hash(self.words.data, self.words.starts, self.words.ends, self.sums)

    def beginning(self, size: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The first `size` bytes as a number, the first byte lowest; words hold no zero byte, so shorter ones stay apart."""
        starts, ends = self.words.starts[which], self.words.ends[which]
        out = np.zeros(len(starts), np.uint64)
        for i in range(size):
            at = starts + i
            inside = at < ends
            out[inside] |= self.words.data[at[inside]].astype(np.uint64) << np.uint64(8 * i)
        return out

    def before(self, own: np.ndarray) -> np.ndarray:
        """40 bits for the word before each word; a text's first word has a place of its own before it."""
        out = np.concatenate(([_BEGIN], own[:-1])) if len(own) else own.copy()
        out[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = _BEGIN
        return context(out)


def context(words: np.ndarray) -> np.ndarray:
    return mix(words) >> np.uint64(24)


def pair_key(own: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(own + before * _ODD)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and the values of those that are."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


@dataclass(frozen=True)
class Model:
    """Log-ratios, toxic to ordinary. `tables` has (keys, values) of words, beginnings from the longest (for words that have no entry), pairs and contexts.

    A pair's ratio replaces that of its word; a context's is added to the word's where the pair has none.
    """

    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    share: float
    slope: np.ndarray

    def _of(self, kind: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _found(*self.tables[kind], asked)

    def ratios(self, text: Expressions) -> np.ndarray:
        """log P(word | word before, toxic) - log P(word | word before, ordinary) of each word."""
        own = text.own()
        before = text.before(own)
        out = np.zeros(len(own))
        left = np.arange(len(out))
        for kind in (WORDS, *BEGINNINGS[::-1]):
            found, value = self._of(kind, own if kind == WORDS else text.beginning(kind, left))
            out[left[found]] = value[found]
            left = left[~found]
        found, value = self._of(CONTEXTS, before)
        out += np.where(found, value, 0.0)
        found, value = self._of(PAIRS, pair_key(own, before))
        return np.where(found, value, out)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: number of words, mean log-ratio of the two models, mean gain of the toxic text's likelihood over the ordinary one's, probability."""
        found = Expressions(texts)
        text, ratio, n = np.repeat(np.arange(len(texts)), found.counts), self.ratios(found), np.maximum(found.counts, 1)
        mean = np.bincount(text, ratio, len(texts)) / n
        gain = np.bincount(text, np.log1p(self.share * np.expm1(ratio)), len(texts)) / n
        return found.counts, mean, gain, _probability(found.counts, gain, self.share, self.slope)


@dataclass(frozen=True)
class FiledModel(Model):
    """The same with its tables in files of a shared folder: `tables` has each kind's number of parts, and a key is in the part that its remainder names.

    Files hold keys in order and then their values. They are mapped, so a task reads what its words ask for and keeps none of it.
    """

    folder: str

    def _of(self, kind: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, values = np.zeros(len(asked), bool), np.zeros(len(asked))
        many = self.tables.get(kind, 0)
        if not many or not len(asked):
            return found, values
        own, at = np.unique(asked, return_inverse=True)
        part = np.mod(own.view(np.int64), many)
        own_found, own_values = np.zeros(len(own), bool), np.zeros(len(own))
        order = np.argsort(part, kind="stable")  # keys stay in order within a part
        for which in np.split(order, np.searchsorted(part[order], np.arange(1, many))):
            path = f"{self.folder}/{kind}-{part[which[0]]}" if len(which) else ""
            if path and os.path.exists(path):
                rows = np.memmap(path, np.uint64, "r").reshape(2, -1)
                own_found[which], own_values[which] = _found(rows[0], rows[1].view(np.float64), own[which])
        return own_found[at], own_values[at]


def _filed(entries: DataFrame, share: float, slope: np.ndarray) -> FiledModel | None:
    """The entries written by their tasks to the checkpoint folder, about PART of them a file; None where that is no folder that Python can open."""
    context = entries.sparkSession.sparkContext
    address = urllib.parse.urlparse(context.getCheckpointDir() or "none:")
    if address.scheme not in ("", "file"):
        return None
    folder = f"{urllib.parse.unquote(address.path)}/model-{uuid.uuid4().hex}"
    many = {r["kind"]: r["count"] // PART + 1 for r in entries.groupBy("kind").count().collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("kind"))

    def write(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        kind, part = (x.as_py() for x in group)
        key, ratio = rows["key"].to_numpy().view(np.uint64), rows["ratio"].to_numpy()
        order = np.argsort(key)
        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/.{kind}-{part}-{uuid.uuid4().hex}"
        np.concatenate([key[order], ratio[order].view(np.uint64)]).tofile(own)
        os.replace(own, f"{folder}/{kind}-{part}")  # a task that runs again writes the same
        return pa.table({"n": pa.array([len(key)], pa.int64())})

    rows = entries.select("kind", "key", "ratio", F.pmod(F.col("key"), parts).alias("part"))
    rows.groupBy("kind", "part").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return FiledModel(many, share, slope, folder)


def _inputs(counts: np.ndarray, gain: np.ndarray, share: float) -> np.ndarray:
    """What the probability is fitted on: the mean gain, alone and against its spread for this length."""
    return np.stack([np.ones(len(counts)), gain / share, gain / share * np.sqrt(np.minimum(counts, 4096.0)) / 16], axis=1)


def _probability(counts: np.ndarray, gain: np.ndarray, share: float, slope: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(counts, gain, share) @ slope, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method, with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * len(y) * w * np.array([0, *[1] * (len(w) - 1)])
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge * len(y)
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def roles(labels: DataFrame, label_col: str, allowed: Column, check_rows: int, id_col: str) -> DataFrame:
    """k, label and role of every allowed labelled id: 2 for at most `check_rows` ids, the first by a hash, that fit the probability; the label for all others.

    Ids to fit on come from three tenths of all, by another hash. An id with several labels has the largest.
    """
    known = labels.filter(allowed & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    apart = F.pmod(F.xxhash64(F.lit("check"), F.col("k")), F.lit(10)) < 3
    check = known.filter(apart).orderBy(F.xxhash64("k"), F.col("k")).limit(check_rows).select("k", F.lit(2).alias("fits"))
    return known.join(F.broadcast(check), "k", "left").select("k", "label", F.coalesce("fits", F.when(F.col("label") == 1, 1).when(F.col("label") == 0, 0)).alias("role"))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_LABELS else rows


def _documents(keys: np.ndarray, text: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """How many of the texts that `which` picks hold each of the n keys."""
    return np.bincount(np.unique(text[which] * n + keys[which]) % n, minlength=n) if which.any() else np.zeros(n, np.int64)


def _common(texts: DataFrame) -> np.ndarray:
    """Hashes of the words that are common in some rows of (text), at most 1 / COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            for batch in batches:
                for *_, part in text_slices(batch.column(0)):
                    words, many = np.unique(Expressions(part).own(), return_counts=True)
                    kept = many * 2 > COMMON * many.sum()
                    yield pa.record_batch([pa.array(words[kept].view(np.int64)), pa.array(many[kept]), pa.array(np.full(kept.sum(), many.sum()))], names=["word", "many", "total"])

    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) < COMMON_ROWS
    rows = texts.filter(first).mapInArrow(run, "word long, many long, total long").groupBy("word").agg(F.max(F.col("many") / F.col("total")).alias("share"))
    rows = rows.filter(F.col("share") > COMMON).orderBy(F.desc("share"), "word").limit(int(1 / COMMON)).toPandas()
    return np.sort(rows["word"].to_numpy(np.int64).view(np.uint64))


def _planes(numbers: np.ndarray, size: int) -> np.ndarray:
    """The lowest `size` bytes of 64-bit numbers, all first bytes before all second ones, which compresses better."""
    return numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T


def _from_planes(planes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(planes) // size, 8), np.uint8)
    out[:, :size] = planes.reshape(size, -1).T
    return out.view(np.uint64)[:, 0]


def _ranked(place: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different name's 40 bits, the most frequent first and else in order, as differences; and for each place its name's rank there."""
    own, at, many = np.unique(place, return_inverse=True, return_counts=True)
    own = names[own]
    order = np.lexsort((own, -many))
    rank = np.empty(len(own), np.uint64)
    rank[order] = np.arange(len(own), dtype=np.uint64)
    return _planes(np.diff(own[order], prepend=np.uint64(0)), 5), _planes(rank[at], 3)


def _named(tails: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The names that `_ranked` has put away."""
    names = np.cumsum(_from_planes(tails, 5), dtype=np.uint64) & np.uint64((1 << 40) - 1)
    return names[_from_planes(ranks, 3)]


def _met(runs: list[tuple[np.ndarray, ...]], words: int, parts: int = 16) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different pairs of all runs by word and place, and the sums of their two counts. A run has pairs (word << 32 | place) in order, each once, and their counts.

    A part of the words is sorted at a time, so what the sort needs besides the runs and the result is small.
    """
    most = sum(len(r[0]) for r in runs)
    out, n = [np.empty(most, np.uint32) for _ in range(4)], 0
    for low in range(0, words, step := words // parts + 1):
        spans = [slice(*np.searchsorted(r[0], [low << 32, (low + step) << 32])) for r in runs]
        pair, *counts = (np.concatenate([r[i][s] for r, s in zip(runs, spans, strict=True)]) for i in range(3))
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        pair = pair[new]
        for own, values in zip(out, (pair >> 32, pair & 0xFFFFFFFF, *[np.add.reduceat(c[order], new) if len(new) else new for c in counts]), strict=True):
            own[n : n + len(new)] = values
        n += len(new)
    word, place, *counts = (own[:n] for own in out)
    return word, place, counts


def _counted(buckets: int, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts (role, text) and sends, for each bucket: words (hash, first 6 bytes, toxic and ordinary documents), how many words precede each,
    these, each different one as 5 bytes of its hash, the toxic and ordinary documents that hold the pair, and contexts with the documents of their pairs."""

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        words, first, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        begin = np.concatenate([h[1] for h in held])[first]
        known = [np.bincount(at, np.concatenate([h[i] for h in held]), len(words)) for i in (2, 3)]
        last, runs = 0, []
        for own, *_, pair, toxic, ordinary in held:
            place = np.append(at[last : last + len(own)], len(words))  # a text's begin comes after all words
            runs.append((place[pair >> 32] << 32 | place[pair & 0xFFFFFFFF], toxic, ordinary))
            last += len(own)
        del at, own, pair, toxic, ordinary
        held.clear()
        word, place, held_pair = _met(runs, len(words))
        del runs
        # Documents add up in contexts, so these need no pairs where they meet.
        names = context(np.append(words, _BEGIN))
        of_contexts = [np.bincount(place, h, len(names)).astype(np.uint32) for h in held_pair]
        small = np.uint16 if buckets <= 1 << 16 else np.uint32
        homes = (names % np.uint64(buckets)).astype(small)
        bucket = (mix(begin) % np.uint64(buckets)).astype(small)[word]
        often = np.isin(words, common)[word]
        bucket[often] = homes[place[often]]
        order = np.argsort(bucket, kind="stable")  # pairs come by word
        del often
        bucket = bucket[order]  # one at a time, so that none is there twice but the one at work
        word = word[order]
        place = place[order]
        for i in range(2):
            held_pair[i] = held_pair[i][order]
        del order
        edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1]))))
        entry, home = word[edge], bucket[edge]
        edge = np.append(edge, len(word))
        once = np.zeros(len(entry), bool)  # a common word's documents are told to one bucket
        once[np.unique(entry, return_index=True)[1]] = True
        columns = [words[entry], begin[entry], *[np.where(once, k[entry], 0).astype(np.uint32) for k in known], np.diff(edge).astype(np.uint32)]
        seen = np.flatnonzero(of_contexts[0] + of_contexts[1])
        seen = seen[np.argsort(homes[seen], kind="stable")]
        homes = homes[seen]
        for target in np.union1d(home, homes).tolist():
            i, j = np.searchsorted(home, [target, target + 1])
            span = slice(edge[i], edge[j])
            own = seen[slice(*np.searchsorted(homes, [target, target + 1]))]
            blob = packed(1, *[c[i:j] for c in columns], *_ranked(place[span], names), *[h[span] for h in held_pair], names[own], *[h[own] for h in of_contexts])
            yield pa.record_batch([pa.array([target]), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    def counts(role: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...] | None:
        found = Expressions(texts)
        own = found.own()
        if not len(own):
            return None
        words, first, at = np.unique(own, return_index=True, return_inverse=True)
        before = np.concatenate(([len(words)], at[:-1]))
        before[(np.cumsum(found.counts) - found.counts)[found.counts > 0]] = len(words)
        pair, where = np.unique(at.astype(np.int64) << 32 | before, return_inverse=True)
        text = np.repeat(np.arange(len(texts)), found.counts)
        which = [(role == label)[text] for label in (1, 0)]
        of_words = [_documents(at, text, w, len(words)).astype(np.uint32) for w in which]
        of_pairs = [_documents(where, text, w, len(pair)).astype(np.uint32) for w in which]
        return words, found.beginning(BEGINNINGS[-1], first), *of_words, pair, *of_pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            held, size = [], 0
            for batch in batches:
                role = batch.column(0).fill_null(-1).to_numpy()
                for i, j, texts in text_slices(batch.column(1)):
                    if (found := counts(role[i:j], texts)) is None:
                        continue
                    held.append(found)
                    del found
                    size += sum(map(len, texts))
                    if size >= FLUSH:
                        yield from sent(held)
                        size = 0
            if held:
                yield from sent(held)

    return run


#: words, begins, toxic, ordinary, sizes; tails, ranks of the pairs' tails; toxic, ordinary of pairs; contexts, toxic, ordinary.
_TYPES = ("<u8", "<u8", "<u4", "<u4", "<u4", "u1", "u1", "<u4", "<u4", "<u8", "<u4", "<u4")
#: kind; key; own: a pair's word; begin: a word's first 6 bytes, a pair's context; counts.
_NUMBERS = {"own": np.int64, "begin": np.int64, "t": np.float64, "o": np.float64, "f": np.float64, "t_freed": np.float64, "o_freed": np.float64}
_FOUND = "kind int, key long, " + ", ".join(f"{c} {'long' if t is np.int64 else 'double'}" for c, t in _NUMBERS.items())


def _gathered(discount: float, pair_discount: float, common: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """A bucket's counts: words (documents, number of different words before); pairs above their discount; contexts that can have such pairs.

    A bucket has all of a beginning's words but for its share of the common ones. Words that no class holds more often than the discount come as one row for each beginning, without key.
    """

    def run(rows: pa.Table) -> pa.Table:
        blobs = [unpacked(b, *_TYPES) for b in rows["blob"].to_pylist()]
        blobs = [(*b[:5], _named(*b[5:7]), *b[7:]) for b in blobs]
        name, begin, toxic, ordinary, sizes, tail, *of_pairs, place, place_toxic, place_ordinary = (np.concatenate(c) for c in zip(*blobs, strict=True))
        del blobs
        words, first, at = np.unique(name, return_index=True, return_inverse=True)
        word = np.repeat(at, sizes)
        order = np.lexsort((tail, word))
        word, tail = word[order], tail[order]
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (tail[1:] != tail[:-1])))[: len(word)])
        held = [np.add.reduceat(h[order].astype(np.int64), new) if len(new) else new for h in of_pairs]
        word, tail = word[new], tail[new]

        def table(kind: int, key: np.ndarray | None, **more: np.ndarray) -> pa.Table:
            n = len(more["t"])
            columns = {c: more[c].astype(t) if c in more else np.zeros(n, t) for c, t in _NUMBERS.items()}
            return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), "key": pa.nulls(n, pa.int64()) if key is None else key.view(np.int64), **columns})

        begin, t, o, f = begin[first].view(np.int64), np.bincount(at, toxic, len(words)), np.bincount(at, ordinary, len(words)), np.bincount(word, minlength=len(words))
        free = {"t_freed": np.minimum(t, discount), "o_freed": np.minimum(o, discount)}
        named = (t > discount) | (o > discount) | np.isin(words, common)
        own = table(WORDS, words[named], begin=begin[named], t=t[named], o=o[named], f=f[named], **{c: x[named] for c, x in free.items()})
        names, of = np.unique(begin[~named], return_inverse=True)
        rest = table(WORDS, None, begin=names, **{c: np.bincount(of, x[~named], len(names)) for c, x in {"t": t, "o": o, "f": f, **free}.items()})
        often = (held[0] > pair_discount) | (held[1] > pair_discount)
        pairs = table(PAIRS, pair_key(words[word[often]], tail[often]), own=words[word[often]].view(np.int64), begin=tail[often], t=held[0][often], o=held[1][often])
        names, of = np.unique(place, return_inverse=True)
        sums = [np.bincount(of, x, len(names)).astype(np.int64) for x in (place_toxic, place_ordinary)]
        large = (sums[0] > pair_discount) | (sums[1] > pair_discount)
        return pa.concat_tables([own, rest, pairs, table(CONTEXTS, names[large], t=sums[0][large], o=sums[1][large])])

    return run


def _counts(docs: DataFrame, known: DataFrame, discount: float, pair_discount: float, id_col: str, text_col: str) -> DataFrame:
    """kind, key, own, begin, t, o, f and what the discount takes off t and o: words, pairs above their discount, and contexts of all documents.

    Nothing is sampled: t and o are the documents of either class that hold an expression, f is the number of different words after which a word stands
    in all documents, labelled or not. Words that no class holds more often than the discount, but for common ones, come as one row for each first 6 bytes, without key. Preceding words
    are told apart by 40 bits of their hash, so of n different ones about n * n / 2^41 are taken for others.
    """
    text = F.col(text_col).cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), total // BUCKET + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text.alias("text"))
    rows = rows.join(_few(known.filter("role < 2").select("k", "role")), "k", "left").select("role", "text")
    common = _common(docs.select(text.alias("text")))
    sent = rows.mapInArrow(_counted(buckets, common), "bucket long, blob binary")
    found = sent.groupBy("bucket").applyInArrow(_gathered(discount, pair_discount, common), _FOUND)
    # A common word's counts add up over buckets.
    sums = {c: F.sum(c) for c in ("t", "o", "f", "t_freed", "o_freed")}
    sums |= {f"{c}_freed": F.when(F.col("key").isNull(), sums[f"{c}_freed"]).otherwise(F.least(sums[c], F.lit(discount))) for c in ("t", "o")}
    return found.groupBy("kind", "key", "own", "begin").agg(*[x.alias(c) for c, x in sums.items()])


def _estimate(n: str, parent: str) -> Column:
    """An expression's share of its context in class n: discounted counts, and the freed mass times the shared estimate."""
    total, shared = F.col(f"{parent}_{n}"), F.col("f") / F.col(f"{parent}_f")
    own = (F.col(n) - F.least(F.col(n), F.col("discount"))) / total + F.col(f"{parent}_{n}_freed") / total * shared
    return F.when(total > 0, own).otherwise(shared)


def _freed(n: str, prefix: str = "") -> Column:
    """Log of the share that a context gives to its shared estimate, in class n; 0 for a context that the class does not have."""
    total = F.col(f"{prefix}{n}")
    return F.when(total > 0, F.ln(F.col(f"{prefix}{n}_freed") / total)).otherwise(0.0)


def _entries(counts: DataFrame, discount: float, pair_discount: float) -> DataFrame:
    """kind, key, ratio: the log-ratios that both models are made of.

    A word, pair or beginning that no class holds more often than the discount has no mass of its own in either, so its ratio is its
    context's alone and needs no entry: entries of beginnings and contexts say just that, and nothing is left out.
    """
    least = [F.sum(F.least(F.col(c), F.lit(discount))).alias(f"{c}_freed") for c in ("t", "o")]
    sums = [F.sum(c).alias(c) for c in ("t", "o", "f")]
    own = counts.filter(F.col("kind") == WORDS).select(F.col("begin").alias("b6"), "key", "t", "o", "f", "t_freed", "o_freed")
    b6 = checkpointed(own.groupBy("b6").agg(*[F.sum(c).alias(c) for c in ("t", "o", "f", "t_freed", "o_freed")]))  # freed: of its words
    b4 = b6.groupBy(F.col("b6").bitwiseAND((1 << 32) - 1).alias("b4")).agg(*sums, *least)
    b1 = b4.groupBy(F.col("b4").bitwiseAND(255).alias("b1")).agg(*sums, *least)
    all_ = b1.agg(F.sum("f").alias("all_f"))

    def up(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumnsRenamed({c: f"{name}_{c}" for c in rows.columns if c != name})

    def step(rows: DataFrame, parents: DataFrame, name: str) -> DataFrame:
        rows = rows.join(up(parents, name), name).withColumn("discount", F.lit(discount))
        logs = {f"l{c}": F.col(f"{name}_l{c}") + F.ln(_estimate(c, name)) for c in ("t", "o")}
        return rows.withColumns(logs).select(*[c for c in rows.columns if not c.startswith(f"{name}_") and c not in ("discount", name)], "lt", "lo")

    b1 = b1.join(F.broadcast(all_)).withColumns({"lt": F.ln(F.col("f") / F.col("all_f")), "lo": F.ln(F.col("f") / F.col("all_f"))}).drop("all_f")
    b1 = checkpointed(b1)
    b4 = checkpointed(step(b4.withColumn("b1", F.col("b4").bitwiseAND(255)), F.broadcast(b1), "b1"))
    b6 = checkpointed(step(b6.withColumn("b4", F.col("b6").bitwiseAND((1 << 32) - 1)), b4, "b4"))
    words = checkpointed(step(own.filter("key is not null"), b6, "b6").select("key", "lt", "lo"))

    out = words.select(F.lit(WORDS).alias("kind"), "key", (F.col("lt") - F.col("lo")).alias("ratio"))
    for size, rows in zip(BEGINNINGS, (b1, b4, b6), strict=True):
        rest = F.col("lt") + _freed("t") - F.col("lo") - _freed("o")
        out = out.unionByName(rows.select(F.lit(size).alias("kind"), F.col(f"b{size}").alias("key"), rest.alias("ratio")))
    pairs = counts.filter(F.col("kind") == PAIRS).select("key", "own", F.col("begin").alias("v"), "t", "o")
    # What the discount frees of a context is all but what pairs above it keep.
    keeps = pairs.groupBy("v").agg(*[F.sum(F.greatest(F.col(c) - pair_discount, F.lit(0.0))).alias(f"{c}_kept") for c in ("t", "o")])
    contexts = counts.filter(F.col("kind") == CONTEXTS).select(F.col("key").alias("v"), "t", "o").join(keeps, "v")
    contexts = checkpointed(contexts.select("v", "t", "o", *[(F.col(c) - F.col(f"{c}_kept")).alias(f"{c}_freed") for c in ("t", "o")]))
    out = out.unionByName(contexts.select(F.lit(CONTEXTS).alias("kind"), F.col("v").alias("key"), (_freed("t") - _freed("o")).alias("ratio")))
    pairs = pairs.join(up(contexts, "v"), "v").join(words.withColumnRenamed("key", "own"), "own")

    def log_of_pair(c: str) -> Column:
        total = F.col(f"v_{c}")
        mass = F.greatest(F.col(c) - pair_discount, F.lit(0.0)) / total + F.col(f"v_{c}_freed") / total * F.exp(F.col(f"l{c}"))
        return F.when(total > 0, F.ln(mass)).otherwise(F.col(f"l{c}"))

    return out.unionByName(pairs.select(F.lit(PAIRS).alias("kind"), "key", (log_of_pair("t") - log_of_pair("o")).alias("ratio")))


@dataclass(frozen=True)
class Fitted:
    """Entries of the models (kind, key, ratio), the same in memory if they are few enough, what turns gains into probabilities, and the entries in files if they are many."""

    entries: DataFrame
    model: Model | None
    share: float
    slope: np.ndarray
    filed: FiledModel | None = None

    @property
    def near(self) -> Model | None:
        """What tasks can look words up in, or None if texts must meet the entries by joins."""
        return self.model or self.filed


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", check_rows: int = 4000, discount: float = 1.5, pair_discount: float = 3.0, share: float = 0.005) -> Fitted | None:
    """The two models of all allowed labelled rows, or None if a class has no row with words.

    Each class has an interpolated Kneser-Ney model of words given the word before. Counts are documents of the class that hold an expression.
    What `pair_discount` takes off the pairs of a context goes to the word alone, and a word is read as its beginnings, one byte, four, six and then itself: at each step `discount`
    is taken off the class's counts, and the freed mass goes to shared counts of all documents, labelled or not: how many different words an expression
    follows. So a word that a class has hardly seen is judged by how it begins, and one that begins like none tells nothing. First bytes have no counts of a class.

    A toxic text is mostly ordinary words, so its likelihood interpolates: `share` of the toxic model and the rest of the ordinary one. The mean
    log-likelihood that this gains over the ordinary model is the evidence. A logistic regression on at most `check_rows` labelled rows that were not counted turns
    it into a probability. `discount` must be at least 1 and at most `pair_discount`.

    Null labels and ids are not learnt from; documents that repeat an id count each. Models of up to MOST_KEYS entries are held in memory, larger ones in files of the checkpoint
    folder, if that is a folder of the file system, or else in a table that texts are joined with.
    """
    if not 1 <= discount <= pair_discount:
        raise ValueError("discounts must be at least 1, the pairs' not below the words'")
    known = checkpointed(roles(labels, label_col, F.lit(True) if allowed is None else allowed, check_rows, id_col))
    counts = checkpointed(_counts(docs, known, discount, pair_discount, id_col, text_col))
    held = counts.filter(F.col("kind") == WORDS).agg(F.sum("t"), F.sum("o")).first()
    if not held[0] or not held[1]:
        return None
    entries = checkpointed(_entries(counts, discount, pair_discount))
    slope, model = np.array([-3.0, 5.0, 0.0]), None
    if entries.count() <= MOST_KEYS:
        rows, tables = entries.toArrow(), {}
        kind, key, ratio = (rows[c].to_numpy() for c in ("kind", "key", "ratio"))
        for k in (WORDS, *BEGINNINGS, PAIRS, CONTEXTS):
            keys, values = key[kind == k].view(np.uint64), ratio[kind == k]
            order = np.argsort(keys)
            tables[k] = (keys[order], values[order])
        model = Model(tables, share, slope)
    fitted = Fitted(entries, model, share, slope, None if model else _filed(entries, share, slope))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(known.filter("role = 2").select("k", "label")), "k")
    check = score(sample, fitted, "label", "text").select(F.col("doc_id").alias("label"), "n_words", "gain").toPandas()
    y = check["label"].to_numpy(np.float64)
    if 0 < y.sum() < len(y):
        slope = _logistic(_inputs(check["n_words"].to_numpy(), check["gain"].to_numpy(), share), y)
        model, filed = (m and replace(m, slope=slope) for m in (fitted.model, fitted.filed))
        fitted = replace(fitted, slope=slope, model=model, filed=filed)
    return fitted


SCORES = "doc_id long, n_words long, mean_ratio double, gain double, score double"


def score(docs: DataFrame, fitted: Fitted | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, mean_ratio, gain and score (0 to 1) of every row; without a model every score is 0.

    mean_ratio is the mean log-ratio of both class models, gain the mean log-likelihood that a toxic text's model gains. Null and empty texts have no
    words and get the score of a gain of 0. Rows that share an id are scored each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    if fitted is not None and fitted.near is None:
        return _score_by_joins(rows, fitted)
    shared = docs.sparkSession.sparkContext.broadcast(fitted and fitted.near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            own = shared.value
            for batch in batches:
                for i, j, texts in text_slices(batch.column(1)):
                    n = j - i
                    counts, *found = own.scores(texts) if own else (np.zeros(n, np.int64), *np.zeros((3, n)))
                    yield pa.record_batch([batch.column(0).slice(i, n), pa.array(counts.astype(np.int64)), *map(pa.array, found)], names=["doc_id", "n_words", "mean_ratio", "gain", "score"])

    return rows.mapInArrow(run, SCORES)


_KEYS = {"own": WORDS, "b6": 6, "b4": 4, "b1": 1, "v": CONTEXTS, "pair": PAIRS}


def _score_by_joins(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """The same scores where the models are too many for one task: the distinct pairs of the texts meet the entries by joins, their sums come back by text."""
    keyed = rows.withColumn("text_key", F.xxhash64("t", F.octet_length("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            for batch in batches:
                for i, _, texts in text_slices(batch.column(1)):
                    found = Expressions(texts)
                    own = found.own()
                    before = found.before(own)
                    text = np.repeat(np.arange(len(texts)), found.counts)
                    pair = pair_key(own, before)
                    order = np.lexsort((pair, text))
                    first = np.flatnonzero(np.concatenate(([True], (np.diff(text[order]) != 0) | (pair[order][1:] != pair[order][:-1]))))[: len(order)]
                    at = order[first]
                    columns = [own[at], *[found.beginning(n, at) for n in (6, 4, 1)], before[at], pair[at]]
                    many = np.diff(np.append(first, len(order)))
                    yield pa.record_batch([batch.column(0).take(pa.array(text[at] + i)), *[pa.array(c.view(np.int64)) for c in columns], pa.array(many)], names=["text_key", *_KEYS, "many"])

    texts = keyed.dropDuplicates(["text_key"]).select("text_key", "t")
    used = texts.mapInArrow(run, "text_key long, " + ", ".join(f"{c} long" for c in _KEYS) + ", many long")
    asked = used.select(*_KEYS).distinct()
    for name, kind in _KEYS.items():
        asked = asked.join(fitted.entries.filter(F.col("kind") == kind).select(F.col("key").alias(name), F.col("ratio").alias(f"{name}_ratio")), name, "left")
    word = F.coalesce("own_ratio", "b6_ratio", "b4_ratio", "b1_ratio", F.lit(0.0))
    ratio = F.coalesce("pair_ratio", word + F.coalesce("v_ratio", F.lit(0.0)))
    sums = used.select("text_key", "pair", "many").join(asked.select("pair", ratio.alias("ratio")), "pair").groupBy("text_key").agg(
        F.sum("many").alias("n_words"), F.sum(F.col("many") * F.col("ratio")).alias("ratio"), F.sum(F.col("many") * F.log1p(F.lit(fitted.share) * F.expm1("ratio"))).alias("gain")
    )
    n = F.coalesce("n_words", F.lit(0))
    mean = {c: F.coalesce(F.col(x) / F.col("n_words"), F.lit(0.0)) for c, x in (("mean_ratio", "ratio"), ("gain", "gain"))}
    out = keyed.drop("t").join(sums, "text_key", "left").select(F.col("k").alias("doc_id"), n.alias("n_words"), *[c.alias(name) for name, c in mean.items()])
    a, b, c = (F.lit(float(x)) for x in fitted.slope)
    x = F.col("gain") / fitted.share
    line = a + b * x + c * x * F.sqrt(F.least(F.col("n_words"), F.lit(4096))) / 16
    return out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0)))))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(crc_bucket(key, 4) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document, by models fitted on the labels that are not held out.

    Nulls, empty texts, repeated rows, empty tables and other columns: see `fit` and `score`.
    """
    model = fit(docs, labels, "toxic", ~held_out(F.col(id_col)), id_col, text_col)
    rows = score(docs, model, id_col, text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "mean_ratio", "gain")


def without_toxic(docs: DataFrame, fitted: Fitted | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns. Without a model every row stays.

    A row is judged by its text alone, so repeated rows and copies share their fate; null and empty texts are judged like any other; an empty table gives no rows.
    """
    if fitted is None:
        return docs
    if fitted.near is None:
        text = F.col(text_col).cast("string")
        key = F.xxhash64(text, F.octet_length(text))
        judged = score(docs.select(key.alias("key"), text.alias("t")).dropDuplicates(["key"]), fitted, "key", "t")
        return docs.join(judged.filter(F.col("score") >= threshold).select(F.col("doc_id").alias("toxic_text")), key == F.col("toxic_text"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(fitted.near)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_worker():
            own = shared.value
            for batch in batches:
                for i, j, texts in text_slices(batch.column(place)):
                    yield batch.slice(i, j - i).filter(pa.array(own.scores(texts)[-1] < threshold))

    return docs.mapInArrow(run, docs.schema)
