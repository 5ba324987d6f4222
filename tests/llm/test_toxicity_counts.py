import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.llm import toxicity


def brute_models(rows, classes, discount=1.5, pair_discount=3.0):
    """log P(word | before) of each class, by the formulas, from dictionaries."""

    def words_of(text):
        return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))))

    before, docs = collections.defaultdict(set), {c: collections.Counter() for c in (0, 1)}
    pairs = {c: collections.Counter() for c in (0, 1)}
    for key, text in rows:
        words = words_of(text)
        own = list(zip([None, *words], words))
        for v, w in own:
            before[w].add(v)
        if key in classes:
            docs[classes[key]].update(set(words))
            pairs[classes[key]].update(set(own))
    follows = {w: len(v) for w, v in before.items()}

    def cut(w, n):
        return w if n is None else w[:n]

    levels = [1, 4, 6, None]
    shared = {n: collections.Counter() for n in levels}
    counts = {(c, n): collections.Counter() for c in (0, 1) for n in levels}
    for w, f in follows.items():
        for n in levels:
            shared[n][cut(w, n)] += f
            for c in (0, 1):
                counts[c, n][cut(w, n)] += docs[c][w]
    freed = {c: collections.Counter() for c in (0, 1)}
    for c in (0, 1):
        for up, n in zip(levels, levels[1:]):
            for x, k in counts[c, n].items():
                # words of one beginning of several lengths are told apart by their own level
                freed[c][up, cut(x, up)] += min(k, discount)

    def log_word(w, c):
        out = math.log(shared[1][w[:1]] / sum(shared[1].values()))
        for up, n in zip(levels, levels[1:]):
            total, k = counts[c, up][cut(w, up)], counts[c, n][cut(w, n)]
            base = shared[n][cut(w, n)] / shared[up][cut(w, up)]
            out += math.log((k - min(k, discount)) / total + freed[c][up, cut(w, up)] / total * base if total else base)
        return out

    totals, loose = {c: collections.Counter() for c in (0, 1)}, {c: collections.Counter() for c in (0, 1)}
    for c in (0, 1):
        for (v, _), k in pairs[c].items():
            totals[c][v] += k
            loose[c][v] += min(k, pair_discount)

    def log_pair(v, w, c):
        base, n = math.exp(log_word(w, c)), totals[c][v]
        return math.log((pairs[c][v, w] - min(pairs[c][v, w], pair_discount)) / n + loose[c][v] / n * base) if n else log_word(w, c)

    def ratios(text):
        words = words_of(text)
        return [log_pair(v, w, 1) - log_pair(v, w, 0) for v, w in zip([None, *words], words)]

    return ratios


@pytest.fixture(params=["in memory", "by joins"])
def size(request, monkeypatch):
    monkeypatch.setattr(toxicity, "FLUSH", 20_000)  # counts are sent several times
    if request.param == "by joins":
        monkeypatch.setattr(toxicity, "MOST_KEYS", 10)


def test_scores_are_those_of_the_models(spark, small, size):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    allowed = ~toxicity.held_out(F.col("doc_id"))
    known = {r.k: r for r in toxicity.roles(labels, "toxic", allowed, 4000, "doc_id").collect()}
    assert all(zlib.crc32(str(k).encode()) % 4 != 2 for k in known)
    ratios = brute_models(rows, {k: r.role for k, r in known.items() if r.role < 2})
    fitted = toxicity.fit(docs, labels, "toxic", allowed)
    found = {r.doc_id: r for r in toxicity.score(docs, fitted).collect()}
    assert len(found) == len(rows)
    for key, text in rows:
        r = np.array(ratios(text))
        gain = np.log1p(0.005 * np.expm1(r)).mean() if len(r) else 0
        assert found[key].n_words == len(r)
        assert found[key].mean_ratio == pytest.approx(r.mean() if len(r) else 0, abs=1e-9)
        assert found[key].gain == pytest.approx(gain, abs=1e-9)
        line = fitted.slope @ [1, gain / 0.005, gain / 0.005 * math.sqrt(min(len(r), 4096)) / 16]
        assert found[key].score == pytest.approx(1 / (1 + math.exp(-line)), abs=1e-9)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, fitted).collect()}
    assert kept == {k for k, r in found.items() if r.score < 0.3} and len(kept) < len(rows)


def test_pairs_have_mass_of_their_own(spark, documents, labels, size):
    rows = [(i, ("you are bad w%d" if i % 2 else "bad you are w%d") % (i % 5)) for i in range(40)]
    docs = documents(rows)
    fitted = toxicity.fit(docs, labels([(i, None, i % 2) for i in range(40)]), check_rows=0)
    assert {r.kind for r in fitted.entries.collect()} == {0, 1, 4, 6, 10, 11}
    ratios = brute_models(rows, {i: i % 2 for i in range(40)})
    for r in toxicity.score(docs, fitted).collect():
        assert r.mean_ratio == pytest.approx(np.mean(ratios(dict(rows)[r.doc_id])), abs=1e-9)
        assert r.mean_ratio > 0.5 if r.doc_id % 2 else r.mean_ratio < -0.5


def test_odd_texts_are_scored_alike_by_joins(documents, labels, odd_rows, monkeypatch):
    known = labels([(4, 1, 1), (5, 0, 0), (6, 0, 0)])
    docs = documents([*odd_rows, (7, "one two " * 400_000)], clash=True)
    plain = toxicity.fit(docs, known, check_rows=0)
    monkeypatch.setattr(toxicity, "MOST_KEYS", 0)
    joined = toxicity.fit(docs, known, check_rows=0)
    assert plain.model is not None and joined.model is None
    a, b = (sorted(((str(r.doc_id), r.n_words, r.gain, r.score) for r in toxicity.score(docs, m).collect())) for m in (plain, joined))
    assert len(a) == len(odd_rows) + 1 and [x[:2] for x in a] == [x[:2] for x in b]
    assert [y for x in a for y in x[2:]] == pytest.approx([y for x in b for y in x[2:]])


def test_an_insult_of_late_labelled_rows_tells(spark, documents, labels):
    """Counts come from all labelled rows, not from the first by a hash."""
    ids = spark.range(14000).withColumn("apart", F.pmod(F.xxhash64(F.lit("check"), F.col("id")), F.lit(10)) < 3)
    usable = ids.filter(~F.col("apart") & ~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id")
    late = {r.id for r in usable.collect()[5000:]}
    assert len(late) > 500
    rows = [(i, f"plain w{i % 50} {'zzquarg' if i in late else 'awful'} w{i % 31}") for i in range(14000)]
    rows += [(20000 + i, f"plain w{i % 50} good w{i % 31}") for i in range(3000)]
    asked = [(30000, "plain w1 zzquarg w2"), (30001, "plain w1 good w2")]
    scores = {r.doc_id: r.score for r in toxicity.toxicity(documents(rows + asked), labels([(i, None, int(i < 20000)) for i, _ in rows])).filter("doc_id >= 30000").collect()}
    assert scores[30000] > 0.9 and scores[30001] < 0.1


def test_large_models_are_read_from_files_without_a_shuffle(spark, small, monkeypatch):
    docs, known = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    fits = {"memory": toxicity.fit(docs, known)}
    monkeypatch.setattr(toxicity, "MOST_KEYS", 10)
    monkeypatch.setattr(toxicity, "PART", 50)
    fits["files"] = toxicity.fit(docs, known)
    monkeypatch.setattr(toxicity, "_filed", lambda *_: None)  # as where the checkpoint folder is not one of the file system
    fits["joins"] = toxicity.fit(docs, known)
    assert fits["files"].model is None and max(fits["files"].filed.tables.values()) > 1 and fits["joins"].near is None
    plan = toxicity.score(docs, fits["files"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want, *others = ({r.doc_id: r for r in toxicity.score(docs, f).collect()} for f in fits.values())
    for found in others:
        assert found.keys() == want.keys() and all(found[k].n_words == want[k].n_words for k in want)
        assert [found[k].score for k in want] == pytest.approx([r.score for r in want.values()], rel=1e-9)
    kept = [sorted(r.doc_id for r in toxicity.without_toxic(docs, f).collect()) for f in fits.values()]
    assert kept[0] == kept[1] == kept[2]


def test_names_of_pairs_come_back_from_fewer_bytes():
    rng = np.random.default_rng(3)
    names = toxicity.context(rng.integers(0, 2**63, 70_000).astype(np.uint64))
    place = (rng.integers(0, 70_000, 300_000) ** 2 // 70_000).astype(np.uint32)
    tails, ranks = toxicity._ranked(place, names)
    assert (toxicity._named(np.frombuffer(tails.tobytes(), np.uint8), np.frombuffer(ranks.tobytes(), np.uint8)) == names[place]).all()
    assert len(toxicity.packed(1, tails, ranks)) < 0.75 * len(toxicity.packed(1, names[place].view(np.uint8).reshape(-1, 8)[:, :5]))
    assert not len(toxicity._named(*(np.frombuffer(x.tobytes(), np.uint8) for x in toxicity._ranked(place[:0], names))))
