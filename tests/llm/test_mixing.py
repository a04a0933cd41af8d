import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.queries import op2_mixing


def brute_targets(sizes, weights=mixing.WEIGHTS, share=1.5, most=2):
    """Share by weight, cut at the caps, share what is over again."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000, None: 50}, {"a": 5}, {"a": 0, "b": 3}, {"a": 0}, {"b": 1, "B": 1, "é": 900, "z": 2, "y": 500}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(rows).collect()}
    for s, want in brute_targets(sizes).items():
        assert got[s]["target"] == pytest.approx(want) and got[s]["rate"] <= 2 and got[s]["source_size"] == sizes[s]


def test_odd_rows(make, clashing, odd_rows):
    docs = clashing(make([(*r, "s" if k % 2 else None) for k, r in enumerate(odd_rows)]), "rate", "target", "place", "cap", "level")
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["copies"] <= 2 and r["taken"] == r["size"] * r["copies"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert len({r["copies"] for r in got if r["doc_id"] == 5 and r["source_size"] == got[0]["source_size"]}) <= 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_empty(make):
    assert mixing.mix_plan(make([])).count() == 0 and mixing.mixed_documents(make([])).count() == 0


def test_near_the_targets_and_the_same_again(make):
    docs = make([(i, "w " * (20 + i % 30), f"s{min(i % 7, 3)}") for i in range(6000)])
    plan = mixing.mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id").cache()
    for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.06)
    assert plan.drop("source").exceptAll(mixing.mix_plan(docs.repartition(9)).select(*plan.drop("source").columns)).count() == 0


def test_query_is_the_sql(spark, small, duck):
    got = {r["doc_id"]: r.asDict() for r in op2_mixing(spark, small).collect()}
    frame = duck(small).execute(mixing.ORACLE_SQL).df()
    assert len(frame) == len(got)
    for r in frame.to_dict("records"):
        assert got[r["doc_id"]] == r


def test_registered_sql_is_text():
    from tessera.llm.queries import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and all(isinstance(x, str) for x in oracle_sql().values())


@pytest.mark.parametrize("doc_id", [7, None])
def test_one_id_for_all_rows_of_a_source(make, doc_id):
    docs = make([(doc_id, f"w{i} " * (20 + i % 30), "a") for i in range(3000)] + [(i, "w " * 30, "b") for i in range(3000)])
    plan = mixing.mix_plan(docs).collect()
    for size in {r["source_size"] for r in plan}:
        own = [r for r in plan if r["source_size"] == size]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.06)
