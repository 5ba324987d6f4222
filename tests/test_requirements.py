from phaseloom.operators.requirements import Requirements, audit

RULES = Requirements(
    min_chars=20, metadata=("doi", "year"), expected={"doi": "10.1/x"}, fragments={"sections_missing": ("## One two", "never there")}, identifiers={"gaps_missing": (r"KG-\d\d", 3)},
    pages=47, tables=11, figures=1, forbidden={"claims": (r"is\s+therefore\s+normal", "proves that")}, timed=("tM", "t2"), unit="hpi|%", medians=((23, 24), (5, 5)),
)
GOOD = "# tM 55\n- **doi:** 10.1/x\n- **year (of print):** 2025\n> ## One\n>two KG-01 KG-02 KG-02\ntM 26 hpi, pp. 3–47, Table 11, Figure 1\nIC1-T2-44 of t2"
BAD = "- **doi:** 10.1/y\np. 0, pp. 46-48, p. 99 Table 12 Figure 2 Figure 3\nThis is\n> THEREFORE normal\nt2 at 26\ntM 27 then 5-5 hpi, 23 – 24 hpi"


def found(spark, rows, **more):
    corpus = spark.createDataFrame([(k, t, 1) for k, t in rows], "id string, text string, t int")
    return {r["check"]: r.n_bad for r in audit(corpus, "id", "text", RULES, **more).collect()}


def test_each_check_counts_what_is_bad(spark):
    sources = spark.createDataFrame([("a", "AB")], "id string, sha256 string")
    listed = spark.createDataFrame([("b",), ("b",), ("z",)], "id string")
    got = found(spark, [("a", GOOD + "\n- **source_sha256:** `ab`"), ("b", BAD), ("c", None)], sources=sources, elsewhere=listed)
    assert got == {
        "short_texts": 1, "no_doi": 1, "no_year": 2, "wrong_doi": 1, "sections_missing": 1, "pages_out_of_range": 3, "tables_out_of_range": 1, "figures_out_of_range": 2,
        "claims": 1, "times_without_unit": 1, "medians_as_ranges": 1, "gaps_missing": 1, "hash_differs": 2, "listed_elsewhere": 1,
    }


def test_empty_corpus_and_repeats(spark):
    got = found(spark, [])
    assert {c: n for c, n in got.items() if n} == {"sections_missing": 2, "gaps_missing": 3}
    assert found(spark, [("b", BAD), ("b", BAD)])["figures_out_of_range"] == 4
    assert {r.passed for r in audit(spark.createDataFrame([("a", "x")], "id string, text string"), "id", "text", Requirements()).collect()} == {1}
