import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, clash=False):
        """Documents of (doc_id, text[, source]); with `clash`, extra columns whose names operators use inside."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for name in ("size", "k", "t", "doc", "row", "blob", "part", "fp", "score", "n_words", "rank", "bin", "copies", "held_out"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "one two three"), (5, "wörd ß İ Σ " * 3), (6, "tail\x00byte <|endoftext|> x")]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
