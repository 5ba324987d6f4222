"""Word-level BPE over the different words of a chunk of texts, merged side by side with numpy."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The cut of a word that numpy repeats; with any other, every word goes through the whole tokenizer.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Longer words are not kept, so that what is kept is bounded.
LONGEST_KEPT = 64
#: Parts of more bytes are merged by the library.
LONGEST_PART = 60
_NONE = np.int32(1 << 30)
_GONE = np.uint32(0xFFFF)
_EMPTY = np.uint32(0xFFFFFFFF)


def spread(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[first:first + size] for each row, one after another."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)]


class Merges:
    """The merges of a BPE model: in each part the pair of lowest rank is joined, the leftmost if there are several, until no pair has a rank."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.ranks = np.full(1 << self.bits, _NONE)
        mask = len(self.keys) - 1
        for rank, (k, slot) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            while self.keys[slot] != _EMPTY:
                slot = slot + 1 & mask
            self.keys[slot], self.ranks[slot] = k, rank << 6

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """64 times each pair's rank, or a number above all ranks."""
        key = left << np.uint32(16) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(todo):
            slot[todo] = slot[todo] + 1 & len(self.keys) - 1
            found, own = self.keys[slot[todo]], key[todo]
            hit = found == own
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != _EMPTY)]
        return out

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts, one after another, and how many each has. A column of `symbols` holds one part of that size, at most 60, and anything below it."""
        n, most = len(sizes), len(symbols)
        at = np.arange(most)[:, None]
        held = np.full((most + 2, n), _GONE)  # the last two rows are behind and before every part
        held[:most] = np.where(at < sizes, symbols, _GONE)
        rank = np.full((most + 2, n), _NONE)
        rank[: most - 1] = self.rank(held[: most - 1].ravel(), held[1:most].ravel()).reshape(most - 1, n) + at[: most - 1].astype(np.int32)
        after = np.broadcast_to(np.arange(1, most + 3)[:, None], (most + 2, n)).copy()
        after[:most][at == sizes - 1] = most
        before = np.broadcast_to(np.arange(-1, most + 1)[:, None], (most + 2, n)).copy()
        before[0] = most + 1
        symbol, ranks, after, before = held.ravel(), rank.ravel(), after.ravel(), before.ravel()
        while True:
            best = rank[:most].min(axis=0)
            column = np.flatnonzero(best < _NONE)
            if not len(column):
                break
            best = best[column]
            place = (best & 63).astype(np.int64)
            here = place * n + column
            right = after[here] * n + column
            next_, last = after[right], before[here]
            beyond, left = next_ * n + column, last * n + column
            new = self.made[best >> 6]
            symbol[here], symbol[right] = new, _GONE
            after[here], before[beyond] = next_, place
            ranks[right] = _NONE
            ranks[here] = self.rank(new, symbol[beyond]) + place
            ranks[left] = self.rank(symbol[left], new) + last
        out = held[:most].T
        kept = out != _GONE
        return out[kept], kept.sum(axis=1)


class WordEncoder:
    """Encodes texts word by word, as the vocabulary drops white space and joins nothing across it.

    The texts of a chunk are taken together: their different words are encoded once, and of words of plain Latin letters each different part
    is. Any other word goes through the whole tokenizer; at most `cached` of them are kept from chunk to chunk.
    """

    def __init__(self, path: str, cached: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        vocab, end = own["model"]["vocab"], own["model"].get("end_of_word_suffix") or ""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that byte-level BPE writes as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.letters = [letters[b] for b in range(256)]
        repeated = own["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == CUT and max(vocab.values()) < 0xFFFF and all(c + e in vocab for c in self.letters for e in ("", end))
        self.plain = regex.compile("[\\n\\x21-\\x7e\\xa1-\\xff]*" if repeated else "\\n*").fullmatch
        self.kind = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(256)], np.uint8)
        self.kind[10] = 0
        self.inner, self.final = (np.array([vocab.get(c + e, 0) for c in self.letters], np.uint32) for e in ("", end))
        self.merges = Merges(vocab, own["model"]["merges"]) if repeated else None
        self.most = cached
        self.words: dict[str, bytes] = {}

    def _cut(self, codes: np.ndarray) -> np.ndarray:
        """Whether a part begins at each letter of words that end in a line feed."""
        kind = self.kind[codes]
        last = np.concatenate(([np.uint8(0)], kind[:-1]))
        begins = (kind != 0) & ((kind != last) | (kind == 2))
        quote = np.flatnonzero((codes == 39) & (last != 3))
        quote = quote[codes[quote + 1] != 10]
        one, two = codes[quote + 1], codes[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[quote[short | long] + 1] = False
        for behind in (quote[short] + 2, quote[long] + 3):
            begins[behind] = kind[behind] != 0
        return begins

    def _parts(self, data: np.ndarray, bounds: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different parts, given by Latin-1 codes, with each part's first place among the ids and its number of ids."""
        wide = data >= 128
        ends = np.cumsum(1 + wide.astype(np.int64))
        raw = np.empty(ends[-1] if len(ends) else 0, np.uint8)  # UTF-8
        raw[ends - 1] = np.where(wide, 0x80 | data & 63, data)
        raw[ends[wide] - 2] = 0xC0 | data[wide] >> 6
        bounds = np.concatenate(([0], ends))[bounds]
        symbols = self.inner[raw]
        symbols[bounds[1:] - 1] = self.final[raw[bounds[1:] - 1]]
        begin, sizes = bounds[:-1], np.diff(bounds)
        order = np.argsort(sizes, kind="stable")
        usual = int(np.searchsorted(sizes[order], LONGEST_PART, "right"))
        found, count = [np.zeros(0, np.uint32)], np.empty(len(sizes), np.int64)
        for i in range(0, usual, block):
            own = order[i : min(i + block, usual)]
            at = begin[own] + np.arange(sizes[own[-1]])[:, None]
            ids, count[own] = self.merges.merged(symbols[np.minimum(at, len(symbols) - 1)], sizes[own])
            found.append(ids)
        for i in order[usual:].tolist():
            part = "".join([self.letters[b] for b in raw[bounds[i] : bounds[i + 1]].tolist()])
            found.append(np.array([t.id for t in self.tokenizer.model.tokenize(part)], np.uint32))
            count[i] = len(found[-1])
        first = np.empty(len(sizes), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(found), first, count

    def _other(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words by the whole tokenizer, or as kept from earlier chunks."""
        out = []
        for word in words:
            ids = self.words.get(word)
            if ids is None:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
                if len(word) <= LONGEST_KEPT:
                    if len(self.words) >= self.most:
                        self.words.clear()
                    self.words[word] = ids
            out.append(np.frombuffer(ids, np.uint32))
        return out

    def _encoded(self, lines: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words, each followed by a line feed, with each word's first place among the ids and its number of ids."""
        odd, others = [], []
        if "<|" in lines or not self.plain(lines):  # added tokens are found in a text before it is cut
            words = lines.split("\n")[:-1]
            odd = [i for i, w in enumerate(words) if "<|" in w or not self.plain(w)]
            others = self._other([words[i] for i in odd])
            for i in odd:
                words[i] = ""
            lines = "".join([w + "\n" for w in words])
        codes = np.frombuffer(lines.lower().encode("latin-1"), np.uint8)
        begins, held = self._cut(codes), codes != 10
        data = codes[held]
        bounds = np.append(np.flatnonzero(begins[held]), len(data))
        found = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        different = found.dictionary
        edges = np.frombuffer(different.buffers()[1], np.int32, len(different) + 1, 4 * different.offset) if len(different) else np.zeros(1, np.int32)
        letters = np.frombuffer(different.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]] if len(different) else np.zeros(0, np.uint8)
        ids, first, count = self._parts(letters, edges - edges[0])
        place = found.indices.to_numpy()
        own = count[place]
        ids = np.concatenate([spread(ids, first[place], own), *others])
        to_word = np.concatenate(([0], np.cumsum(begins)))[np.flatnonzero(~held)]  # parts up to each word's end
        ends = np.concatenate(([0], np.cumsum(own)))[to_word]
        count = np.diff(ends, prepend=0)
        first = ends - count
        if odd:
            count[odd] = [len(x) for x in others]
            first[odd] = len(ids) - np.cumsum(count[odd][::-1])[::-1]
        return ids, first, count

    def _coded(self, column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """A chunk's different words, encoded, the place of each word among them and the bounds of each text's words."""
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary())
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")[0].as_py() + b"\n" * bool(len(words))
        return self._encoded(lines.decode("utf-8", "replace")), coded.indices.to_numpy(), split.offsets.to_numpy()

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text of a string column; a null text has none."""
        (_, _, count), place, bounds = self._coded(column)
        return np.diff(np.concatenate(([0], np.cumsum(count[place])))[bounds])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after another, and their bounds: text i has ids[bounds[i]:bounds[i + 1]]. A null text has none."""
        (ids, first, count), place, bounds = self._coded(column)
        own = count[place]
        return spread(ids, first[place], own), np.concatenate(([0], np.cumsum(own)))[bounds]

    def packed(self, text: bytes) -> bytes:
        """The ids of one text, as little-endian unsigned 32-bit integers."""
        words = text.split()
        own = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, first, count = self._encoded(b"".join([w + b"\n" for w in own]).decode("utf-8", "replace"))
        place = np.array([own[w] for w in words], np.int64)
        return spread(ids, first[place], count[place]).astype("<u4").tobytes()
