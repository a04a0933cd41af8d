import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, source]) rows."""

    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Columns with names that operators use themselves."""

    def add(df, *names):
        from pyspark.sql import functions as F

        for name in (*names, "size", "rank", "id", "key", "part", "word", "votes", "start", "host", "component", "unit"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("clash"))
        return df

    return add


LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "   "), (4, LONG), (5, "one"), (5, "one"), (None, "no id"), (6, "ünïcödé 😀 " * 30)]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)
