"""URL filter, mix, vector search, classifiers and the pipeline."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phaseloom.llm import annsearch, mixing, quality, toxicity, urlcascade
from phaseloom.llm.queries import URL_RULES


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    _, rule, action = max(fits, default=(0, None, "allow"))
    return host, path, rule, action


URLS = [None, "", "no scheme/org/", "http://", "http://org/", "http://ORG/x?y", "http://a.org", "http://a.org?x/", "https://b.example.org/en/1", "https://example.org/en/2", "https://example.org/en/12#f", "ftp://xexample.org/es/", "http://x.com/fr/a://b", "http://x.com/fr", "http://com/de/", "http://x.org:80/", "http://É.org/ü", "a://b://org/"]


def test_url_filter_matches_brute_force(spark, small):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, None), (None, "http://a.org/")], "page_id long, url string")
    pages = pages.withColumn("key", F.lit(1)).withColumn("listed", F.lit(2)).withColumn("host", F.lit(3))
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlcascade.filter_urls(pages, URL_RULES).collect())
    want = collections.Counter((r.page_id, *brute_verdict(r.url, URL_RULES)) for r in pages.collect())
    assert got == want
    real = spark.read.parquet(f"{small}/pages.parquet")
    assert {tuple(r) for r in urlcascade.filter_urls(real, URL_RULES).collect()} == {(r.page_id, *brute_verdict(r.url, URL_RULES)) for r in real.collect()}
    assert urlcascade.filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urlcascade.filter_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(3)) == 0).alias("listed"))
    levels = urlcascade.build_cascade(keys)
    rows = keys.toPandas()
    assert len(levels) > 3
    assert (urlcascade.is_listed(rows.h1.to_numpy(), rows.h2.to_numpy(), levels) == rows.listed.to_numpy()).all()
    with pytest.raises(ValueError):
        urlcascade.build_cascade(keys, most_bytes=100)


def water_levels(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: weight[s] * left / total for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_reaches_targets(documents):
    rng = np.random.default_rng(5)
    sources = ["a", "b", "c", "d", "Z", "é", None]
    rows = [(i, "w " * int(rng.integers(0, 60)), sources[int(rng.choice(7, p=[0.4, 0.3, 0.05, 0.1, 0.05, 0.05, 0.05]))]) for i in range(3000)]
    rows += [(3000, None, "a"), (3001, "", "empty"), (3002, "x " * 20, "z"), (None, "x y", "b"), (7, "w w", "a"), (7, "w w", "a")]
    got = mixing.mix(documents(rows, clash=True)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets, taken = water_levels(sizes), collections.Counter()
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(3, 0.02 * targets[s])
    again = mixing.mix(documents(rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = mixing.mixed(documents(rows, clash=True))
    assert whole.columns == documents(rows, clash=True).columns
    assert whole.count() == sum(r.copies for r in got)
    assert mixing.mix(documents([])).count() == 0


def test_mix_prefers_important_documents(documents):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    got = mixing.mix(documents(rows), importance=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0)).collect()
    high, low = (np.mean([r.copies for r in got if (r.doc_id % 4 < 2) == x]) for x in (True, False))
    assert high > 2 * low
    for s in "ab":
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(next(r.target for r in got if r.source == s), abs=10)


def test_mix_includes_documents_at_the_rates_asked_for(documents):
    """Sizes 10 and 1000 have 4 and 10 binary digits; over many random orders a document comes as often as its expectation says."""
    rows = [(i, "w " * (1000 if i % 20 == 0 else 10), "ab"[i % 2]) for i in range(400)] + [(1000 + i, "w " * 500, "c") for i in range(20)]
    docs = documents(rows)
    runs = [mixing.mix(docs, importance=mixing.digits_of(mixing.word_count(F.col("text"))), salt=f"s{k}").collect() for k in range(12)]
    for source in "abc":
        sizes = collections.Counter(r.size for r in runs[0] if r.source == source)
        target = next(r.target for r in runs[0] if r.source == source)
        level = next(x for x in np.arange(0, 3.001, 0.0005) if sum(n * s * min(3, x * s.bit_length()) for s, n in sizes.items()) >= target - 1e-6)
        for s in sizes:
            mean = np.mean([r.copies for run in runs for r in run if r.source == source and r.size == s])
            assert mean == pytest.approx(min(3, level * s.bit_length()), abs=0.12)


def brute_nearest(rows, k):
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q % 20 == 0:
            best = sorted(((-float(np.dot(v, w)), i) for i, w in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_vector_search_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(400)]
    same = rows[3][1]
    rows += [(400 + i, same) for i in range(60)] + [(600, None), (620, [0.0] * 8), (640, [None] + [1.0] * 7), (660, [float("nan")] * 8), (680, [float("inf")] * 8), (700, []), (None, same), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x")).withColumn("score", F.lit(0))
    got = annsearch.search(df, df.filter("vec_id % 20 = 0"), k=20, probe_share=1.0, chunk=100)
    found = collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows, 20)
    assert set(found) == set(want)
    hits = total = 0
    for q in want:
        assert len(found[q]) == 20 and [s for _, s in found[q]] == sorted([s for _, s in found[q]], reverse=True)
        hits += len({i for i, _ in found[q]} & {i for i, _ in want[q]})
        total += 20
    assert hits / total > 0.97
    few = df.filter("vec_id in (0, 5, 7)")
    assert sorted((r.vec_id, r.rank) for r in annsearch.search(few, few.filter("vec_id = 0")).collect())[0][1] in (1, 2)
    assert annsearch.search(few, few.filter("vec_id = 0")).count() == 2
    assert annsearch.search(df.limit(0), df).count() == 0


def test_vector_search_recall(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    index = annsearch.fit_index(vectors.select("vec_id", F.col("embedding").alias("vector")), list_size=32, probe_share=0.75)
    got = annsearch.search(vectors, vectors.filter("vec_id % 20 = 0"), index=index).collect()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & {r.vec_id for r in got if r.query_id == ids[q]})
    assert hits / len(got) >= 0.9


def auc(y, s):
    y, s = np.array(y), np.array(s)
    order = np.argsort(np.argsort(s)) + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifier_on_held_out_labels(spark, name):
    sf = "/root/testdata/sf0.01" if name == "quality" else "/root/testdata/sf0.1"  # sf0.01 has 2 to 8 toxic rows of each other language to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = (quality.quality if name == "quality" else toxicity.toxicity)(docs, labels)
    rows = scored.join(labels, "doc_id").filter("held_out").select(name, "score", "predicted").collect()
    assert auc([r[0] for r in rows], [r.score for r in rows]) > (0.95 if name == "quality" else 0.97)
    assert np.mean([r[0] == r.predicted for r in rows]) > (0.9 if name == "quality" else 0.97)
    key, rest = (5, 0) if name == "quality" else (4, 2)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % key == rest) for r in scored.collect())


@pytest.mark.parametrize("module,score", [(quality, 0.5), (toxicity, 0.0)])
def test_classifiers_of_odd_rows(documents, labels, odd_rows, module, score):
    run = module.quality if module is quality else module.toxicity
    none = run(documents(odd_rows, clash=True), labels([])).collect()
    assert len(none) == len(odd_rows) and {r.score for r in none} == {score}
    known = labels([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 1, 1), (4, 0, 0), (5, 0, 1), (6, 0, 0), (99, 1, 1)])
    some = run(documents(odd_rows, clash=True), known).collect()
    assert len(some) == len(odd_rows) and all(0 <= r.score <= 1 for r in some)
    assert run(documents([]), known).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for module, name, run in ((quality, "quality", quality.quality), (toxicity, "toxic", toxicity.toxicity)):
        turned = labels.withColumn(name, F.when(module.held_out(F.col("doc_id")), 1 - F.col(name)).otherwise(F.col(name)))
        a, b = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, turned))
        assert a == pytest.approx(b)


def test_pipeline_of_odd_rows(spark, documents, labels, odd_rows, tmp_path):
    labels([(4, 1, 1), (5, 0, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([*odd_rows, (9, "w " * 300_000), (9, "w " * 300_000)], []):
        docs = documents(rows, clash=True).drop("n_chars")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{len(rows)}_{k}")
            before, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{len(rows)}_{k}")
            assert docs.columns == before and (docs.count() > 0) == bool(rows)


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.toxicity(before, spark.read.parquet(f"{small}/labels.parquet")).filter("score < 0.3")
            assert ids == {r.doc_id for r in scores.collect()}
        if name == "near_dedup":
            from tests.llm.test_text_operators import brute_components, brute_fingerprint

            groups = brute_components({r.doc_id: brute_fingerprint(r.text) for r in before.collect()})
            assert ids == set(groups.values())
        if name == "substring_dedup":
            from tests.llm.test_text_operators import brute_dedup

            want = brute_dedup([(r.doc_id, r.text) for r in before.collect()])
            assert ids == {key for key, (n, gone, _) in want.items() if n == 0 or gone < n}
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == (want[r.doc_id][2] if want[r.doc_id][1] else texts[r.doc_id]) for r in docs.collect())
    rows = before.count()
    assert docs.select(F.sum("length")).first()[0] > rows and docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, small).count() == docs.count()
