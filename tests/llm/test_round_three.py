"""Byte-level BPE, the filter audit and the lexical ranking against brute force, and their results for odd rows."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from phaseloom.llm import bytebpe, filteraudit, maskrank
from phaseloom.llm.queries import queries
from phaseloom.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def public():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bytebpe.pattern(), mergeable_ranks=bytebpe.read_ranks(vocabulary(bytebpe.RANKS)), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.Encoder(vocabulary(bytebpe.RANKS), cached=50)


def ids_of(own, text):
    return np.frombuffer(own.packed(text), "<i4").tolist()


def test_transducer_encodes_as_the_public_library(public, own):
    rng = np.random.default_rng(0)
    letters = [chr(c) for c in range(32, 127)] + list("äößéñçıİ漢字かなあ🙂👩‍💻русский العربية हिन्दी́‍ 　\x1c\x1f\x85﻿\n\r\t")
    for _ in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else list("abcde "), rng.integers(0, 40)))
        assert ids_of(own, text) == public.encode_ordinary(text)
    plain = [chr(c) for c in range(128)]
    for _ in range(3000):
        text = "".join(rng.choice(plain if rng.random() < 0.5 else list("ab1 '\n"), rng.integers(0, 30)))
        assert text.isascii() and ids_of(own, text) == public.encode_ordinary(text)
    tokens = list(own.machine.ranks)
    for _ in range(3000):
        piece = b"".join(tokens[i] for i in rng.integers(0, len(tokens), rng.integers(1, 8)))
        assert own.machine.encode(piece) == own.machine.encode(piece) == public._core_bpe.encode_single_piece(piece)


def test_transducer_forgets_states_and_takes_long_pieces(public, own):
    small = bytebpe.Transducer(own.machine.ranks, most_states=20)
    for text in ["internationalisation", "unbelievable", "x" * 5000, "ab" * 3000, "漢字" * 400] * 3:
        assert small.encode(text.encode()) == public._core_bpe.encode_single_piece(text.encode())
    long = "word and 123 wörds  " * 70_000
    assert ids_of(own, long) == public.encode_ordinary(long)


def test_merges_out_of_order_are_done_plainly():
    single = {bytes([b]): b for b in range(256)}
    early = single | {b"abc": 256, b"ab": 257}  # older than its own part
    assert bytebpe.Transducer(early).encode(b"xabcab") == [120, 256, 257]
    alone = single | {b"ab": 256, b"bcd": 257}  # no merges lead to bcd: it stands for a whole piece only
    machine = bytebpe.Transducer(alone)
    assert machine.alone == {b"bcd": 257} and machine.encode(b"bcd") == [257] and machine.encode(b"bcda") == [98, 99, 100, 97]
    assert machine.encode(b"") == []


def test_stream_of_any_ids_decodes_as_python_does(own):
    stream, rng = bytebpe.StreamDecoder(own.machine.tokens), np.random.default_rng(1)
    for _ in range(3000):
        ids = [int(rng.integers(256) if rng.random() < 0.5 else rng.integers(50256)) for _ in range(rng.integers(0, 12))]
        cut = int(rng.integers(0, len(ids) + 1))
        raw = b"".join(own.machine.tokens[i] for i in ids)
        assert stream.feed(ids[:cut]) + stream.feed(ids[cut:]) + stream.finish() == raw.decode("utf-8", "replace")
        parts = [stream.feed([i]) for i in ids]
        assert "".join(parts) + stream.finish() == raw.decode("utf-8", "replace")


def test_query_of_byte_bpe(spark, small, public):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op11_byte_bpe"](spark, small).collect()}

    def want(text):
        ids = public.encode_ordinary(text)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    assert found == {k: want(t) for k, t in rows.items()}


def test_byte_bpe_of_odd_rows(documents, odd_rows, public):
    rows = [*odd_rows, (9, "é" * 30_000)]
    found = bytebpe.encode(documents(rows, clash=True), decoded=True)
    got = [(r.doc_id, list(r.ids), r.decoded) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(k, public.encode_ordinary(t or ""), t or "") for k, t in rows], key=str)
    back = bytebpe.decode(found.withColumnRenamed("decoded", "text"))
    assert sorted([(r.doc_id, r.text) for r in back.collect()], key=str) == sorted([(k, t or "") for k, t in rows], key=str)
    assert bytebpe.encode(documents([])).count() == 0 and bytebpe.decode(bytebpe.encode(documents([]))).count() == 0


def brute_audit(rows, labels):
    known = {}
    for k, quality, toxic in labels:
        if k is not None:
            known.setdefault(k, []).append((quality == 1, toxic == 1))
    least = {}
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    docs = []
    for k, text, source in rows:
        t, words = text or "", (text or "").encode().split()
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > least[t]]
        of = known.get(k, [])
        docs.append((source or "", fails, any(q for q, _ in of), any(x for _, x in of)))
    out = {}
    for part in {d[0] for d in docs}:
        removed_by = Counter()
        for order in itertools.permutations(range(5)):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, i in enumerate(order, 1):
                hit = [d for d in left if d[1][i]]
                name = "".join("ABCDE"[j] for j in order)
                single = sum(d[1][i] and sum(d[1]) == 1 for d in docs if d[0] == part)
                out[part, name, step] = [len(left) - len(hit), len(hit), sum(d[1][i] for d in gone), single, sum(d[2] for d in hit), sum(d[3] for d in hit)]
                removed_by[i] += len(hit)
                gone, left = gone + hit, [d for d in left if not d[1][i]]
        for (p, name, step), row in out.items():
            if p == part:
                row.append(removed_by["ABCDE".index(name[step - 1])])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_matches_brute_force(documents, labels):
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n", "A B C", "a " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i}" for i in range(220)) + " 5 %", "é" * 40 + " ÀB", "x # y", "many\x0bkinds\x0cof\rspace " * 60]
    rows = [(int(rng.integers(0, 60)) if rng.random() < 0.9 else None, texts[rng.integers(len(texts))], [None, "", "s", "t"][rng.integers(4)]) for _ in range(150)]
    marks = [(int(k), int(rng.integers(2)), int(rng.integers(2))) for k in rng.integers(0, 60, 50)] + [(None, 1, 1), (3, None, None)]
    found = filteraudit.audit(documents(rows, clash=True), labels(marks), buckets=5, flush_bytes=3000)
    assert audit_rows(found) == brute_audit(rows, marks)
    assert filteraudit.audit(documents([]), labels([])).count() == 0


def test_matrix_has_every_word_of_every_text(documents):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(400)], rng.integers(0, 90)))) for i in range(300)] + [(1000, "long " * 300_000), (1001, None)]
    pieces = filteraudit.term_matrix(documents(rows).repartition(3), buckets=7, flush_bytes=2000).collect()
    assert len({p.shard for p in pieces}) > 3
    names, seen = {}, 0
    texts = dict(rows)
    for p in pieces:
        assert len(p.indptr) == len(p.docs) + 1
        for d, x, y in zip(p.docs, p.indptr[:-1], p.indptr[1:], strict=True):
            row = dict(zip(p.indices[x:y], p.data[x:y], strict=True))
            want = Counter((texts[d.doc] or "").split())
            assert sorted(row.values()) == sorted(want.values()) and len(row) == y - x
            seen += 1
            for code in row:  # a code is one word everywhere: the words that all its documents share
                names[code] = names.get(code, set(want)) & set(want)
    assert seen == len(rows) and all(names.values()) and len(names) == len({w for t in texts.values() for w in (t or "").split()})


def brute_ranking(rows, items, k=10):
    def terms(text):
        return [t.decode() for t in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))]

    docs = [(key, Counter(terms(t))) for key, t in rows]
    docs = [(key, c) for key, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, own in asked.items():
        found = []
        for key, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, key is None, key))
        for rank, (score, _, key) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = (key, -score)
    return out


def ranking_of(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


def test_ranking_matches_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert ranking_of(queries()["op13_lexical_ranking"](spark, small)) == brute_ranking(docs, items)


@pytest.mark.parametrize("most_pairs,shard", [(10**6, 7), (40, 50)])
def test_ranking_of_odd_rows_ties_and_many_terms(spark, documents, odd_rows, most_pairs, shard):
    rng = np.random.default_rng(7)
    word = [f"t{i}" for i in range(150)] + ["É", "é", "İ", "漢字"]
    rows = [*odd_rows, *((int(rng.integers(100, 140)), "-".join(rng.choice(word, rng.integers(0, 60)))) for _ in range(120)), (500, "T1 t2 " * 30_000), (None, "t3 t4"), (501, "t5"), (502, "t5"), (503, "t5")]
    items = [(1, "T1, t2; t3!"), (2, None), (3, ""), (4, " ".join(word)), (1, "t9"), (5, "nowhere"), (6, "t5"), (None, "t7 É")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", maskrank.F.lit("x")).withColumn("rank", maskrank.F.lit("x"))
    found = maskrank.rank_documents(documents(rows, clash=True).repartition(3), table, most_pairs=most_pairs, shard_docs=shard)
    assert ranking_of(found) == brute_ranking(rows, items)
    few = maskrank.rank_documents(documents(rows), table, k=3, shard_docs=shard)
    assert ranking_of(few) == brute_ranking(rows, items, 3)


def test_ranking_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert maskrank.rank_documents(documents([]), some).count() == 0
    assert maskrank.rank_documents(documents([(1, "one")]), none).count() == 0
    assert ranking_of(maskrank.rank_documents(documents([(1, "one"), (2, None)]), some)) == brute_ranking([(1, "one"), (2, None)], [(1, "one")])


def test_bound_rises_with_tf_and_falls_with_length():
    tf, m = np.arange(1, 400), np.arange(10, 400)
    assert (np.diff(maskrank.bound(tf, np.int64(50))) >= 0).all() and (np.diff(maskrank.bound(np.int64(3), m)) <= 0).all()
    assert maskrank.lengths([10**9], 10**12, 10**13).tolist() == [10 + 90 * 10**8]
