"""The word encoder of operators 5 and 8 merges the different parts of a chunk side by side; held against the whole tokenizer, text by text."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from phaseloom.llm import packing, tokens, wordbpe


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokens.vocabulary())


def ids_of(enc, texts):
    column = pa.array(texts, pa.string())
    ids, bounds = enc.ids(column)
    assert enc.lengths(column).tolist() == np.diff(bounds).tolist() and len(bounds) == len(texts) + 1
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def made_up(rng, letters, n, longest):
    return ["".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(0, longest))) for _ in range(n)]


def test_texts_of_a_chunk_are_encoded_like_each_alone(whole):
    rng = np.random.default_rng(8)
    latin = [chr(c) for c in range(1, 256)]
    texts = [
        *made_up(rng, latin, 400, 60),
        *made_up(rng, list("'strevmldx1!  A"), 1500, 12),  # shortened forms beside letters, digits, signs and each other
        *made_up(rng, list("aaabnoctieEéÉµ "), 600, 90),
        *made_up(rng, [*latin, "́", "’", "漢", "Σ", "İ", " ", "　", "<|", "<|endoftext|>"], 300, 30),
        *(c * n for c in "ae1!'éß" for n in (1, 2, 29, 30, 31, 59, 60, 61, 62, 63, 64, 65, 500)),
        None,
        "",
        " \t\r\n",
        "it's we'll they've 'S I'M 'll'll ''s !'s 1's 's's don't",
    ]
    rng.shuffle(texts)
    enc = tokens.WordEncoder(tokens.vocabulary(), cached=50)
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids_of(enc, texts) == expected
    assert ids_of(enc, texts[::-1]) == expected[::-1]  # with what was kept
    assert len(enc.words) <= 50
    assert ids_of(enc, []) == [] and ids_of(enc, [None, ""]) == [[], []] and ids_of(enc, ["漢", None]) == [whole.encode("漢").ids, []]
    sliced = pa.array(texts, pa.string()).slice(7, 20)
    assert ids_of(enc, sliced.to_pylist()) == expected[7:27] and enc.lengths(sliced).tolist() == [len(x) for x in expected[7:27]]


def test_plain_words_do_not_go_to_the_library_one_by_one():
    enc = tokens.WordEncoder(tokens.vocabulary())

    class Counted:
        calls = 0
        model = property(lambda self: self)

        def encode(self, *args, **kwargs):
            Counted.calls += 1

        tokenize = encode

    enc.tokenizer = Counted()
    rng = np.random.default_rng(9)
    texts = [" ".join(made_up(rng, list("abcdefghilmnoprstuéü"), 50, 12)) + ".,!" for _ in range(40)]
    enc.ids(pa.array(texts))
    assert Counted.calls == 0


def test_another_cut_goes_through_the_whole_tokenizer(tmp_path):
    with open(tokens.vocabulary(), encoding="utf-8") as file:
        own = file.read()
    path = tmp_path / "other.json"
    path.write_text(own.replace("'s|'t|'re|", "'s|'re|", 1), encoding="utf-8")
    other = Tokenizer.from_file(str(path))
    texts = ["Don't we're", "it's 12 été", ""]
    assert ids_of(tokens.WordEncoder(str(path)), texts) == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_merges_take_the_lowest_rank_leftmost():
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "aa", "ab", "abc", "bc"])}
    merges = wordbpe.Merges(vocab, ["b c", "a a", "a b", "ab c"])
    parts = ["aaa", "abc", "aaaa", "ab", "c"]
    symbols = np.array([[vocab[c] for c in p.ljust(4, "a")] for p in parts], np.uint32).T
    ids, sizes = merges.merged(symbols, np.array([len(p) for p in parts]))
    names = list(vocab)
    assert [names[i] for i in ids] == ["aa", "a", "a", "bc", "aa", "aa", "ab", "c"] and sizes.tolist() == [2, 2, 2, 1, 1]


def test_pieces_of_a_table_are_the_texts_ids(spark, whole):
    rows = [(i, t) for i, t in enumerate(["it's été 漢", None, "a" * 70, "", "word " * 3000])]
    found = {}
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    for key, text in rows:
        assert b"".join(ids for _, ids in sorted(found[key])) == np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
