import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest as n
from tessera.llm.queries import op3_nearest


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2), (1, 4)])
def test_the_curve_walks_from_cell_to_cell(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = n.hilbert(cells, bits)
    walk = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_exact(spark):
    x = np.random.default_rng(1).standard_normal((120, 8)).astype(np.float32)
    x[7] = x[3]
    got = results(n.nearest(table(spark, x), F.col("vec_id") % 20 == 0))
    assert got == {q: n.reference_nearest(np.arange(120), x, q) for q in range(0, 120, 20)}


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_recall_with_many_ranges(spark, spread):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((20, 24))
    x = (centers[rng.integers(0, 20, 4000)] * (1 - 0.9 * (spread == 1.0)) + spread * rng.standard_normal((4000, 24))).astype(np.float32)
    got = results(n.nearest(table(spark, x), F.col("vec_id") % 100 == 0, range_rows=200))
    hits = total = 0
    for q in range(0, 4000, 100):
        want = dict(n.reference_nearest(np.arange(4000), x, q))
        hits += sum(i in want and want[i] == s for i, s in got[q])
        total += len(want)
    assert hits / total >= 0.9


def test_fewer_rows_are_scored_than_by_a_scan(spark):
    x = np.random.default_rng(5).standard_normal((20_000, 24)).astype(np.float32) * np.linspace(1, 0.1, 24, dtype=np.float32)
    rows = table(spark, x).select("vec_id", F.col("embedding").alias("vector"))
    curves, half = n.fitted(rows, 10)
    assert curves.ranges == 20 and n.CURVES * 2 * half < 0.7
    positions = curves.positions(x.astype(np.float64), np.arange(len(x)))
    assert all(np.bincount(curves.places(p), minlength=20).max() < 2 * n.RANGE_ROWS for p in positions)


def test_repeated_rows_and_ids(spark):
    x = np.random.default_rng(6).standard_normal((3000, 6)).astype(np.float32)
    ids = [0] * 1500 + [100] * 1000 + list(range(1, 501))
    got = results(n.nearest(table(spark, x, ids), F.col("vec_id") % 100 == 0, range_rows=100))
    assert all(len({i for i, _ in v}) == 10 and q not in {i for i, _ in v} for q, v in got.items())
    alike = results(n.nearest(table(spark, np.ones((3000, 4), np.float32), [7] * 2000 + [100] * 1000), F.col("vec_id") % 100 == 0, range_rows=100))
    assert alike == {100: [(7, 0.0)]}


def test_huge_and_tiny_components(spark):
    for unit in (1e160, 3e300, 1e-160):
        rows = [(i, [unit * (i % 7 + 1), unit * i, unit]) for i in range(40)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = results(n.nearest(df, F.col("vec_id") == 0))
        want = sorted((float(np.hypot(i % 7 + 1 - 1, i)), i) for i in range(1, 40))[:10]
        assert [i for i, _ in got[0]] == [i for _, i in want] and np.allclose([s / unit for _, s in got[0]], [d for d, _ in want])


def test_one_common_vector(spark):
    x = np.random.default_rng(3).standard_normal((3000, 8)).astype(np.float32)
    x[500:2500] = x[500]
    got = results(n.nearest(table(spark, x), F.col("vec_id") % 500 == 0, range_rows=100))
    assert [s for _, s in got[1000]] == [0.0] * 10 and len({i for i, _ in got[1000]}) == 10


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (200, [float("inf"), 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("place", F.lit(2)).withColumn("score", F.lit(3))
    got = results(n.nearest(df, F.col("vec_id") % 100 == 0))
    assert got == {0: [(7, 0.0), (100, 2**0.5)], 100: [(0, 2**0.5), (7, 2**0.5)]}
    assert n.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert n.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_query(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    x, ids = np.stack(frame["embedding"]).astype(np.float64), frame["vec_id"].to_numpy()
    got = results(op3_nearest(spark, small))
    assert got == {q: n.reference_nearest(ids, x, q) for q in ids[ids % 100 == 0]}
