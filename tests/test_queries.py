"""Every registered query of the core library against its SQL in DuckDB."""

import pytest

from tessera.plans import catalogue, oracle

SQL = oracle.statements()


def rows_of(frame):
    """Sorted rows with floats by their shortest form and every kind of null alike."""
    columns = sorted(frame.columns)

    def plain(x):
        if x is None or x != x or str(x) in ("<NA>", "NaT"):
            return "null"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return columns, sorted(tuple(plain(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, small, duck):
    found = catalogue.queries()[name](spark, small).toPandas()
    assert len(found)
    if name in SQL:
        assert rows_of(found) == rows_of(duck(small).execute(SQL[name]).df())


def test_a_page_ranks_only_up_to_its_end(spark, small, monkeypatch):
    from tessera.operators import search

    whole = catalogue.queries()["all_results"](spark, small).where("rank between 6 and 10").toPandas()

    def never(*args):
        raise AssertionError("everything was ranked")

    monkeypatch.setattr(search, "rank_all", never)
    assert rows_of(catalogue.queries()["page_2"](spark, small).toPandas()) == rows_of(whole)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score"]
