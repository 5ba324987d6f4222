"""Operators over whole texts against brute force, and their results for odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phaseloom.llm import media, packing, simhash, superkmer, textscan, tokens
from phaseloom.llm.queries import queries


def brute_dedup(rows, window=20):
    seen, out = {}, {}
    for key, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            if seen.setdefault(own, (key, s)) != (key, s):
                gone[s : s + window] = [True] * window
        out[key] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    top = {k: k for k in prints}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def texts(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def test_substring_dedup_matches_brute_force(spark, small):
    rows = texts(spark, small)
    found = superkmer.dedup_substrings(spark.read.parquet(f"{small}/documents.parquet"), flush_bytes=100_000, buckets=5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found.collect()} == brute_dedup(rows)
    query = {r.doc_id: r.kept_sha256 for r in queries()["op2_substring_dedup"](spark, small).collect()}
    assert query == {k: hashlib.sha256(v[2].encode()).hexdigest() for k, v in brute_dedup(rows).items()}


@pytest.mark.parametrize("window,minimiser", [(2, 1), (3, 2), (5, 3)])
def test_substring_dedup_of_few_words(documents, window, minimiser):
    rng = np.random.default_rng(window)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 30)))) for i in range(60)] + [(99, "a " * 500)]
    found = superkmer.dedup_substrings(documents(rows), window=window, minimiser=minimiser, buckets=3, flush_bytes=200)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found.collect()} == brute_dedup(rows, window)


def test_substring_dedup_of_odd_rows(documents, odd_rows):
    rows = [*odd_rows, (7, " ".join(f"w{i}" for i in range(50))), (8, " ".join(f"w{i}" for i in range(30))), (7, " ".join(f"w{i}" for i in range(50)))]
    found = superkmer.dedup_substrings(documents(rows, clash=True), carried=("doc_id", "text", "row", "blob", "lang"), joined=False)
    out = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()]
    assert len(out) == len(rows) and {r.row.lang for r in found.collect()} == {"en"} and "text" not in found.schema["row"].dataType.names
    assert {x[3] for x in out if x[0] == 1} == {None} and {x[3] for x in out if x[0] == 3} == {"   \n\t "}
    assert [x[1:3] for x in out if x[0] == 7] == [(50, 0), (50, 0)] and [x[1:3] for x in out if x[0] == 8] == [(30, 30)]
    assert [x[1:3] for x in out if x[0] is None] == [(3, 0)]
    assert superkmer.dedup_substrings(documents([])).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(superkmer, "span_hash", lambda data, s, e: np.zeros(len(s), np.uint64))
    strings = [b"a b c d ", b"b c d e ", b"a b c "]
    data = np.frombuffer(b"".join(strings), np.uint8)
    doc, start, size = np.array([1, 2, 3]), np.array([0, 0, 0], np.int32), np.array([len(s) for s in strings], np.int32)
    got = superkmer.first_windows(doc, start, size, data, 3)
    assert [list(x) for x in got] == [[1, 2], [0, 1], [2, 1]]


def test_fingerprints_and_components_match_brute_force(spark, small):
    rows = texts(spark, small)
    prints = {k: brute_fingerprint(t) for k, t in rows}
    found = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries()["op6_simhash_dedup"](spark, small).collect()}
    components = brute_components(prints)
    assert found == {k: (prints[k], components[k]) for k in prints}


def test_links_lose_none_in_dense_groups(spark):
    rng = np.random.default_rng(1)
    codes = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    centre = 0x0123456789ABCDEF
    for _ in range(300):
        code = centre
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            code ^= 1 << int(b)
        codes.add(code)
    codes |= {0, 1, 3, 7, 15, 31, 63, (1 << 64) - 1}
    signed = {c: c - (1 << 64) if c >> 63 else c for c in codes}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    want = brute_components(dict(zip(sorted(codes), sorted(codes), strict=True)))
    groups = {}
    for c in codes:
        groups.setdefault(want[c], set()).add(signed[c])
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1
    assert len({found.get(s, s) for s in signed.values()}) == len(groups)


def test_index_prunes_and_finds_all_pairs():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 20, 400).astype(np.uint64) << np.uint64(7))
    roots = (codes >> np.uint64(25)).astype(np.int64)
    order = np.lexsort((simhash.gray_rank(codes), roots))
    codes, roots = codes[order], roots[order]
    roots = np.cumsum(np.diff(roots, prepend=roots[0]) != 0)
    got = {tuple(sorted(p)) for a, b in simhash.GrayIndex(codes, roots, fan=3).pairs(4, step=64) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if roots[i] == roots[j] and int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert got == want


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(odd_rows, clash=True)).collect()]
    assert sorted(found, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, None), (5, 5), (6, 6)], key=str)
    kept = simhash.without_near_duplicates(documents(odd_rows, clash=True))
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 4, None, 5, 6], key=str)
    assert simhash.near_duplicates(documents([])).count() == 0


def brute_groups(rows):
    """For each row (id, text) its component as a set of row numbers, by linked fingerprints alone."""
    prints = {i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)}
    found = brute_components(prints)
    return [{j for j in found if found[j] == found[i]} for i in range(len(rows))]


def near_texts():
    words = [f"w{i}" for i in range(400)]
    a = " ".join(words)
    return a, a.replace("w399", "z"), " ".join(f"v{i}" for i in range(300))


def test_shared_ids_do_not_join_texts(documents):
    a, near, b = near_texts()
    assert (brute_fingerprint(a) ^ brute_fingerprint(near)).bit_count() <= 4
    rows = [(3, a), (5, near), (5, b), (9, b)]
    found = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents(rows)).collect()}
    assert found == {(3, brute_fingerprint(a), 3), (5, brute_fingerprint(near), 3), (5, brute_fingerprint(b), 5), (9, brute_fingerprint(b), 5)}
    assert sorted((r.doc_id, r.text) for r in simhash.without_near_duplicates(documents(rows, clash=True)).collect()) == [(3, a), (5, b)]


@pytest.mark.parametrize("seed", range(4))
def test_one_row_of_each_group_stays(documents, seed):
    rng = np.random.default_rng(seed)
    a, near, b = near_texts()
    texts = [a, near, b, None, "", "one two", "one two three four five", a + " x", b.replace("v299", "q")]
    rows = [(None if rng.random() < 0.15 * (seed % 2) else int(rng.integers(0, 30 if seed < 3 else 10_000)), texts[rng.integers(len(texts))]) for _ in range(50)]
    groups = brute_groups(rows)
    least = [min([rows[j][0] for j in g if rows[j][0] is not None], default=None) for g in groups]
    found = sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents(rows)).collect()], key=str)
    assert found == sorted([(k, brute_fingerprint(t), least[i]) for i, (k, t) in enumerate(rows)], key=str)
    kept = [(r.doc_id, r.text) for r in simhash.without_near_duplicates(documents(rows, clash=True)).collect()]
    owners = {}
    for row in kept:
        i = rows.index(row)
        assert row[0] == least[i]
        owners.setdefault(frozenset(groups[i]), []).append(row)
    assert set(owners) == {frozenset(g) for g in groups} and all(len(v) == 1 for v in owners.values())


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer(odd_rows):
    enc = tokens.WordEncoder(tokens.vocabulary(), cached=3)
    for text in [t for _, t in odd_rows] + ["It's a test, isn't it? 123 ½ ² µ ª ÀÉ naïve — 漢字 e\u0301 a_b __ '' 's 'S", "x\u00a0y\u3000z \u1680 \x85 \x1c", "ǅ ŉ ﬁ ΑΣ ΣΑΣ İstanbul"]:
        assert enc.packed((text or "").encode()) == np.array(reference_ids(text), "<u4").tobytes()


def test_packing_places_every_token_once(spark, small, documents, odd_rows):
    rows = texts(spark, small)[:60] + [(1000 + i, t) for i, (_, t) in enumerate(odd_rows)] + [(5000, "word " * 5000)]
    pieces = packing.pack(documents(rows, clash=True).coalesce(1), group_windows=8).collect()
    own, sequences = {}, {}
    for p in pieces:
        own.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for key, text in rows:
        ids = b"".join(bytes(p.ids) for p in sorted(own[key], key=lambda p: p.start))
        assert ids == np.array([*reference_ids(text), 1], "<u4").tobytes()
        assert all(p.doc_tokens == len(ids) // 4 for p in own[key])
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        used, padded = used + at, padded + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padded < 0.1 * used
    assert packing.pack(documents([])).count() == 0


def test_differencing_is_near_equal_and_rises():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 512, 500)
    windows = packing.differencing(sizes, 60)
    sums = np.bincount(windows, sizes, minlength=60)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 16
    tight = np.array([600, 600, 600, 600])
    assert packing.fill(tight, 1000).max() == 3 and packing.fill(np.array([5]), 10).tolist() == [0]


def test_length_histogram_answers_every_limit(spark, small, documents, odd_rows):
    rows = texts(spark, small)[:50] + list(odd_rows)
    lengths = [len(reference_ids(t)) for _, t in rows]
    hist = tokens.length_histogram(documents(rows, clash=True), block=64)
    for r in hist.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths) and r.docs_below == sum(x < r.n_tokens for x in lengths)
    totals = {r.context_limit: (r.total_tokens, r.docs_cut) for r in tokens.truncated_totals(hist, [0, 7, 100, 10**6]).collect()}
    assert totals == {n: (sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in (0, 7, 100, 10**6)}
    quantiles = {r.level: r.n_tokens for r in tokens.length_quantiles(hist, [0.5, 1.0]).collect()}
    assert quantiles == {q: sorted(lengths)[int(np.ceil(q * len(lengths))) - 1] for q in (0.5, 1.0)}
    empty = tokens.length_histogram(documents([]))
    assert empty.count() == 0 and [tuple(r) for r in tokens.truncated_totals(empty, [5]).collect()] == [(5, 0, 0)]


def test_media_round_trip(spark, documents, odd_rows):
    rows = [*odd_rows, (9, "x" * 576), (10, "x" * 577)]
    found = media.document_media(documents(rows, clash=True)).collect()
    assert len(found) == len(rows)
    for key, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        for r in [r for r in found if r.doc_id == key and r.n_bytes == len(raw)]:
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.document_media(documents([])).count() == 0
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"\0" * 576)[:-20] + b"\1" * 20)


def test_page_sequences_keep_order(spark):
    html = '<title>T</title><script>no</script><p>Hello <b>big</b> world<figure><img src="media:ab" alt="alt"><figcaption>Cap <i>x</i></figcaption></figure><p>end &amp; <img src=b.jpg alt=B>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    items = media.sequences(pages)
    got = {r.id: [(x.position, x.kind, x.text, x.ref, x.caption) for x in r["items"]] for r in items.collect()}
    assert got == {1: [(0, "text", "T", None, None), (1, "text", "Hello big world", None, None), (2, "media", None, "media:ab", "Cap x"), (3, "text", "end &", None, None), (4, "media", None, "b.jpg", "B")], 2: [], 3: []}
    facts = spark.createDataFrame([("ab", "known")], "digest string, feature string")
    joined = {r.position: (r.caption, r.feature) for r in media.resolved(items, facts).collect()}
    assert joined[2] == ("Cap x", "known") and joined[4] == ("B", None) and len(joined) == 5


def test_hash_of_longs_is_sparks(spark):
    values = np.array([0, 1, -1, 42, 2**63 - 1, -(2**63)])
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "i int, v long").select("i", F.xxhash64("v").alias("h")).orderBy("i").collect()
    assert [r.h for r in rows] == textscan.xxh64_of_longs(values).tolist()
