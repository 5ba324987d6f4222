"""Byte-level BPE as a finite-state transducer that is determinised while it runs, and decoding as a stream with a UTF-8 state machine."""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.textscan import CHUNK, KEPT, text_slices
from phaseloom.llm.tokens import vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"


def pattern() -> str:
    """The public pattern whose matches are encoded one by one."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def ascii_form(pattern: str) -> str:
    """The pattern for texts of ASCII alone, whose letters and numbers are few: Python's own expressions are quicker."""
    for name, own in (("[^\\s\\p{L}\\p{N}]", "[^\\sA-Za-z0-9]"), ("\\p{L}", "[A-Za-z]"), ("\\p{N}", "[0-9]")):
        pattern = pattern.replace(name, own)
    return pattern


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges themselves, lowest rank first, leftmost of equals."""
    return merged_upto(piece, ranks, 1)


def merged_upto(piece: bytes, ranks: dict[bytes, int], least: int) -> list[bytes]:
    """The parts when no merge is left, or already when there are `least`."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class _Made(dict):
    """Values of integers, made on first use; beyond `most` of them all are forgotten."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: int) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class _State(dict):
    """Living guesses (last token, place in the trie, tokens not yet emitted), oldest first. By byte: the next state and what is emitted on the way, or None if asked for once."""

    __slots__ = ("after",)

    def __init__(self, after: tuple):
        self.after = after


class Ambiguous(Exception):
    """A place has no encoding or several, or merges are not in order of rank: vocabularies made by merges never show that. Such pieces are merged plainly."""


class Transducer:
    """Tokens of a vocabulary's merges, read byte by byte.

    Tokens that follow one another are an encoding exactly if each is its own encoding and each two neighbours are the encoding of their bytes. So the
    transducer guesses: it goes through the trie of tokens and, at a token's end that fits the token before, may begin the next. All guesses alive form one
    state. For each prefix one guess has just ended a token, which is the prefix's encoding; tokens on which all living
    guesses agree are emitted. A guess lives at most as long as the longest token, which bounds the lookahead.

    States are made lazily: a step that is taken a second time becomes a transition, one taken for the first time goes on with the guesses themselves, depth first, to the
    piece's end, as most rare words never come back. `most_states` bounds memory: beyond it, all states are forgotten and made anew.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 100_000):
        self.ranks, self.most = ranks, most_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.next: dict[int, int] = {}  # node * 256 + byte: node
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        self.alone: dict[bytes, int] = {}  # tokens that merges do not yield: they stand for a whole piece only
        self.ordered = True  # every token is younger than the two parts that its last merge joins
        self.first: dict[bytes, tuple[bytes, ...]] = {}  # what stands first while a token is merged, and what stands last
        self.last: dict[bytes, tuple[bytes, ...]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = merged_upto(token, ranks, 2)
            if len(parts) > 2 or len(parts) == 2 and parts[0] + parts[1] not in ranks:
                self.alone[token] = rank
                continue
            self.ordered &= all(ranks.get(p, rank) < rank for p in parts if p != token)
            self.first[token] = (*self.first.get(parts[0], (parts[0],))[: None if len(parts) > 1 else 0], token)
            self.last[token] = (*self.last.get(parts[-1], (parts[-1],))[: None if len(parts) > 1 else 0], token)
            node = 0
            for b in token:
                self.inner[node] = True
                to = self.next.get(node << 8 | b)
                if to is None:
                    to = self.next[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = to
            self.ends[node] = rank
        self.fit = _Made(self._fits, 300_000)
        self.known: dict[tuple, _State] = {}
        self.forget()

    def forget(self) -> None:
        for state in self.known.values():
            state.clear()
        self.start = _State(((-1, 0, ()),))
        self.known = {self.start.after: self.start}

    def _fits(self, pair: int) -> bool:
        """Whether the bytes of both tokens are encoded as these two.

        With merges in order of rank, only what stands at the seam matters: the last part of one and the first of the other grow by their own merges, and
        a token across the seam must be younger than the next of them, as the leftmost of equals goes first.
        """
        a, b = self.tokens[pair >> 20], self.tokens[pair & (1 << 20) - 1]
        ranks, never = self.ranks, len(self.ranks)
        left, right, i, j = self.last[a], self.first[b], 0, 0
        while True:
            grow_left = ranks[left[i + 1]] if i + 1 < len(left) else never
            grow_right = ranks[right[j + 1]] if j + 1 < len(right) else never
            across = ranks.get(left[i] + right[j], never)
            if across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def step(self, state: _State, byte: int) -> tuple[_State, tuple]:
        """The transition, made from the guesses."""
        after, ended = [], None
        for last, node, out in state.after:
            to = self.next.get(node << 8 | byte)
            if to is None:
                continue
            if self.inner[to]:
                after.append((last, to, out))
            token = self.ends[to]
            if token >= 0 and (last < 0 or self.fit[last << 20 | token]):
                if ended:
                    raise Ambiguous
                ended = (token, 0, (*out, token))
        if ended is None:
            raise Ambiguous
        after.append(ended)
        emitted = after[0][2]
        for _, _, out in after:
            while out[: len(emitted)] != emitted:
                emitted = emitted[:-1]
        if emitted:
            after = [(last, node, out[len(emitted) :]) for last, node, out in after]
        key = tuple(after)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = _State(key)
        return to, emitted

    def ends_from(self, node: int, text: bytes, at: int) -> list[tuple[int, int]]:
        """Where tokens end that go on from a place in the trie, shortest first, and which they are."""
        follow, ends, out = self.next.get, self.ends, []
        for byte in text[at:]:
            node = follow(node << 8 | byte)
            if node is None:
                break
            at += 1
            if ends[node] >= 0:
                out.append((at, ends[node]))
        return out

    def go_on(self, state: _State, rest: bytes) -> list[int]:
        """What follows the emitted tokens if `rest` comes last: the guesses themselves, depth first, longest token first.

        A place is reached by one way at most, the encoding of what lies before it, so a place from which no way leads to the end is left aside for good.
        """
        fit, n, dead = self.fit, len(rest), bytearray(len(rest) + 1)
        for last, node, out in state.after:
            stack, tokens = [(0, last, self.ends_from(node, rest, 0))], []
            while stack:
                at, last, found = stack[-1]
                while found:
                    end, token = found.pop()
                    if not dead[end] and (last < 0 or fit[last << 20 | token]):
                        tokens.append(token)
                        if end == n:
                            return [*out, *tokens]
                        stack.append((end, token, self.ends_from(0, rest, end)))
                        break
                else:
                    stack.pop()
                    if tokens:
                        tokens.pop()
                        dead[at] = 1
        raise Ambiguous

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.alone:
            return [self.alone[piece]]
        if len(self.known) > self.most:
            self.forget()
        state, out = self.start, []
        try:
            if not self.ordered:
                raise Ambiguous
            for i, byte in enumerate(piece):
                move = state.get(byte)
                if move is None:
                    if byte not in state:
                        state[byte] = None
                        return out + self.go_on(state, piece[i:])
                    move = state[byte] = self.step(state, byte)
                state, emitted = move
                if emitted:
                    out += emitted
        except Ambiguous:
            return [self.ranks[t] for t in merged(piece, self.ranks)]
        return [*out, *state.after[-1][2]]  # the last guess stands between tokens


class _Pieces(dict):
    """What short pieces became, in two generations of `most` pieces each: a full one becomes the older, and what is asked for there moves to the younger."""

    def __init__(self, machine: Transducer, most: int):
        self.machine, self.most = machine, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = struct.pack(f"<{len(ids := self.machine.encode(piece.encode()))}i", *ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Whole texts: each match of the pattern goes through the transducer, unless it is among the up to 2 x `cached` short ones whose ids are kept."""

    def __init__(self, path: str, cached: int = 400_000):
        import regex

        self.machine = Transducer(read_ranks(path))
        self.cut = regex.compile(pattern())
        self.cut_ascii = re.compile(ascii_form(pattern()), re.ASCII)
        self.pieces = _Pieces(self.machine, cached)

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        cut = self.cut_ascii if text.isascii() else self.cut
        if len(text) <= CHUNK:
            return b"".join(map(self.pieces.__getitem__, cut.findall(text)))
        out = bytearray()
        for found in cut.finditer(text):
            out += self.pieces[found.group()]
        return bytes(out)


def _machine() -> tuple[list[list[int]], list[int]]:
    """States of UTF-8 by byte (-1: no character goes on so), and how many bytes of an unfinished character each state holds; state 0 is between characters."""
    # Fixed values of the UTF-8 definition: first bytes, the range of the second byte, further bytes.
    leads = [((0xC2, 0xDF), (0x80, 0xBF), 0), ((0xE0, 0xE0), (0xA0, 0xBF), 1), ((0xE1, 0xEC), (0x80, 0xBF), 1), ((0xED, 0xED), (0x80, 0x9F), 1),
             ((0xEE, 0xEF), (0x80, 0xBF), 1), ((0xF0, 0xF0), (0x90, 0xBF), 2), ((0xF1, 0xF3), (0x80, 0xBF), 2), ((0xF4, 0xF4), (0x80, 0x8F), 2)]
    moves, held = [[0 if b < 0x80 else -1 for b in range(256)]], [0]

    def state(low: int, high: int, to: int, bytes_held: int) -> int:
        moves.append([to if low <= b <= high else -1 for b in range(256)])
        held.append(bytes_held)
        return len(moves) - 1

    for (first, last), (low, high), more in leads:
        to = 0
        for k in range(more):
            to = state(0x80, 0xBF, to, more + 1 - k)
        to = state(low, high, to, 1)
        for b in range(first, last + 1):
            moves[0][b] = to
    return moves, held


class StreamDecoder:
    """Ids to text as they come: `feed` gives all characters that are complete, `finish` the rest. Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character.

    A state of the UTF-8 machine and a token lead to one state, which is looked up once it is known; only tokens that break a character go byte by byte.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.moves, self.held = _machine()
        self.table: list[dict[int, int]] = [_Made(functools.partial(self._over, s), len(tokens)) for s in range(len(self.moves))]
        whole = np.zeros(max(tokens) + 1, bool)
        whole[[i for i in tokens if self._over(0, i) == 0]] = True
        self.whole = whole  # tokens that begin and end between characters
        self.state, self.left = 0, b""

    def _over(self, state: int, token: int) -> int:
        for b in self.tokens[token]:
            state = self.moves[state][b]
            if state < 0:
                break
        return state

    def feed(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        listed = ids.tolist()
        data = self.left + b"".join(map(self.tokens.__getitem__, listed))
        state = self.state
        if state or not self.whole[ids].all():
            for i in listed:
                state = self.table[state][i]
                if state < 0:
                    return self._mended(data)
        return self._cut(data, state)

    def _cut(self, data: bytes, state: int) -> str:
        self.state, whole = state, len(data) - self.held[state]
        self.left = data[whole:]
        return data[:whole].decode()

    def _mended(self, data: bytes) -> str:
        out, state, begin, i = [], 0, 0, 0
        while i < len(data):
            to = self.moves[state][data[i]]
            if to >= 0:
                state, i = to, i + 1
                continue
            out += [data[begin : i - self.held[state]].decode(), "�"]
            i += state == 0  # a byte that begins no character goes; one that breaks a character is looked at again
            state, begin = 0, i
        return "".join(out) + self._cut(data[begin:], state)

    def finish(self) -> str:
        rest = "�" if self.left else ""
        self.state, self.left = 0, b""
        return rest


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> StreamDecoder:
    return StreamDecoder({rank: token for token, rank in read_ranks(path).items()})


KEPT += [encoder, decoder]


def _decoded(stream: StreamDecoder, ids: np.ndarray | list[int], block: int = 4096) -> str:
    text = "".join([stream.feed(ids[i : i + block]) for i in range(0, len(ids), block)])
    return text + stream.finish()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row; with `decoded`, also the text that the ids decode to.

    A null or empty text has no ids. Rows that share an id stay rows of their own, other columns are ignored, an empty table gives no rows. Nothing is shuffled.
    """
    path = tokenizer_path or vocabulary(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stream = encoder(path), decoder(path)  # they stay with the worker from task to task
        for batch in batches:
            for i, j, texts in text_slices(batch.column(1)):
                packed = [own.packed(t.decode("utf-8", "replace")) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed])))
                ids = np.frombuffer(b"".join(packed), "<i4")
                out = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    out.append(pa.array([_decoded(stream, ids[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string()))
                yield pa.record_batch(out, names=["doc_id", "ids", "decoded"][: len(out)])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return base.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids or none give an empty text, null items of a list are passed over, ids outside of the vocabulary are an error."""
    path = tokenizer_path or vocabulary(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = decoder(path)
        for batch in batches:
            texts = [_decoded(stream, [i for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    base = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "doc_id long, text string")
