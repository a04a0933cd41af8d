import numpy as np
import pytest

from tessera.operators import baselines, bounds, evaluation, local_index, search, shards
from tessera.sources.config import load_config


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((80, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[11] = x[4]  # a tie
    shard = np.arange(80) % 8
    rows = spark.createDataFrame([(i, v.tolist(), int(s)) for i, (v, s) in enumerate(zip(x, shard, strict=True))], "id long, vector array<double>, shard_id int").repartition(5)
    q = rng.standard_normal((6, 10))
    q[0] = x[4]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    return x, shard, rows.cache(), q, queries


def brute(x, q, k, allowed=None):
    scores = np.round(x @ q, 6)
    ids = range(len(x)) if allowed is None else allowed
    return [(i, scores[i]) for i in sorted(ids, key=lambda i: (-scores[i], i))[:k]]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def test_exact_and_ties(world):
    x, _, rows, q, queries = world
    got = found(search.block_topk(rows, queries, 5))
    assert got == {i: brute(x, q[i], 5) for i in range(6)}
    assert [i for i, _ in got[0][:2]] == [4, 11]


def test_blocks_of_queries_change_nothing(world, monkeypatch):
    _, _, rows, _, queries = world
    whole = found(search.block_topk(rows, queries, 5))
    monkeypatch.setattr(search.query_blocks, "__defaults__", (200,))
    assert found(search.block_topk(rows, queries, 5)) == whole


def test_routes(world):
    x, shard, rows, q, queries = world
    routes = {i: {i, (i + 1) % 8} for i in range(6)}
    got = found(search.block_topk(rows, queries, 5, routes=routes))
    assert got == {i: brute(x, q[i], 5, [j for j in range(80) if shard[j] in routes[i]]) for i in range(6)}
    everywhere = {i: set(range(8)) for i in range(6)}
    assert found(search.block_topk(rows, queries, 5, routes=everywhere)) == found(search.block_topk(rows, queries, 5))


def test_more_than_there_is_and_nothing(world, spark):
    _, _, rows, _, queries = world
    assert search.block_topk(rows, queries, 500).count() == 6 * 80
    assert search.block_topk(rows.where("id < 0"), queries, 5).count() == 0
    assert search.block_topk(rows, queries.where("query_id < 0"), 5).count() == 0


def test_euclidean(world):
    x, _, rows, q, queries = world
    got = found(search.block_topk(rows, queries, 3, "euclidean"))
    for i in range(6):
        gap = np.round(-np.linalg.norm(x - q[i], axis=1), 6) + 0.0
        assert [j for j, _ in got[i]] == sorted(range(80), key=lambda j: (-gap[j], j))[:3]


def test_places(world):
    x, _, rows, q, queries = world
    top = search.block_topk(rows, queries, 7)
    at = {r["query_id"]: (r["place"], r["capacity"]) for r in search.places(rows, search.kth_results(top, queries, 7)).collect()}
    assert at == {i: (7, 80) for i in range(6)}
    none = {r["query_id"]: r["place"] for r in search.places(rows, search.kth_results(top, queries, 8)).collect()}
    assert none == {i: 80 for i in range(6)}


def test_places_in_bounded_blocks(world, monkeypatch):
    x, shard, rows, q, queries = world
    routes = {i: {i, (i + 1) % 8} for i in range(6)}
    targets = search.kth_results(search.block_topk(rows, queries, 7, routes=routes), queries, 7)
    largest = []
    monkeypatch.setattr(search, "CELLS", 12)
    monkeypatch.setattr(search, "scores_of", lambda a, b, metric: largest.append(len(a) * len(b)) or a @ b.T)
    count = {}

    class Rows:  # the batch function, called here
        sparkSession = rows.sparkSession
        select = lambda self, *columns: self

        def mapInPandas(self, function, schema):  # noqa: N802
            count["of"] = function
            return rows.sparkSession.createDataFrame([], schema)

    search.places(Rows(), targets, routes)
    frame = rows.toPandas()
    got = list(count["of"](iter([frame[:40], frame[40:]])))
    assert max(largest) <= 12 and len(got) == 1
    assert {r.query_id: (r.place, r.capacity) for r in got[0].itertuples()} == {i: (7, 20) for i in range(6)}
    assert {r["query_id"]: (r["place"], r["capacity"]) for r in search.places(rows, targets, routes).collect()} == {i: (7, 20) for i in range(6)}


def test_recall_and_precision(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "query_id int, id int")
    got = search.recall_precision(pairs([(1, 1), (1, 2), (2, 9), (4, 1)]), pairs([(1, 1), (1, 3), (2, 9), (3, 5)]), 10)
    assert {r["query_id"]: (r["recall"], r["precision"]) for r in got.collect()} == {1: (0.5, 0.5), 2: (1.0, 1.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_shards(world, spark):
    x, shard, rows, _, _ = world
    for r in shards.shard_table(rows).collect():
        own = x[shard == r["shard_id"]]
        c = own.mean(axis=0)
        c /= np.linalg.norm(c)
        assert r["item_count"] == len(own) and np.allclose(r["centroid"], c)
        assert r["euclidean_radius"] == pytest.approx(np.linalg.norm(own - c, axis=1).max())
        assert r["angular_radius"] == pytest.approx(np.arccos(np.clip(own @ c, -1, 1)).max())


def test_kmeans_uses_every_shard(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0, 0.001 * (i == 5)]) for i in range(12)], "id long, vector array<double>")
    got = shards.kmeans_shards(same, 4)
    assert got.count() == 12 and {r[0] for r in got.select("shard_id").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        shards.kmeans_shards(same, 13)


def test_bad_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    assert [r["id"] for r in shards.valid_vectors(df, "id", "v").collect()] == [1]


def test_large_matrices_stay_off_the_driver(world):
    with pytest.raises(ValueError):
        shards.matrix(world[2], "id", "vector", limit=100)


def test_bounds_hold(world, spark):
    from pyspark.sql import functions as F

    from tessera.functions.vectors import distance, dot

    _, _, rows, _, queries = world
    centers = shards.shard_table(rows)
    pairs = rows.join(centers.drop("item_count", "path"), "shard_id").crossJoin(queries.withColumnRenamed("vector", "q"))
    score, real = dot(F.col("q"), F.col("centroid")), dot(F.col("q"), F.col("vector"))
    low, high = bounds.ball_bounds(score, score, F.col("euclidean_radius"))
    tight_low, tight_high = bounds.angular_bounds(score, F.col("angular_radius"))
    near = bounds.min_distance(distance(F.col("q"), F.col("centroid")), F.col("euclidean_radius"))
    bad = pairs.where((real < low - 1e-9) | (real > high + 1e-9) | (real < tight_low - 1e-9) | (real > tight_high + 1e-9) | (distance(F.col("q"), F.col("vector")) < near - 1e-9))
    assert bad.count() == 0


def test_pruning_certificates(spark):
    rows = [(1, 0, True, 0.9), (1, 1, False, 0.4), (2, 0, True, 0.9), (2, 1, False, 0.7), (3, 0, True, 0.9), (3, 1, False, None), (4, 0, True, 0.1), (5, 0, False, 0.1)]
    limits = spark.createDataFrame(rows, "query_id int, shard_id int, routed boolean, upper double")
    kth = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5), (5, None)], "query_id int, kth_score double")
    got = {r["query_id"]: r["certified"] for r in bounds.pruning_certificate(limits, kth).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_unclipped_bounds_for_long_queries(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.struct(*bounds.ball_bounds(F.lit(2.0), F.lit(2.0), F.lit(0.5), 3.0, unit=False)).alias("b")).first()["b"]
    assert tuple(row) == (0.5, 3.5)


def test_calibration(world):
    _, _, rows, _, queries = world
    centers = shards.centroids(rows)
    got = evaluation.calibrate(rows, queries, centers, 5, (1, 2, 4, 8, 99), 0.9)
    recalls = [got.mean_recall[p] for p in (1, 2, 4, 8)]
    assert recalls == sorted(recalls) and got.mean_recall[8] == 1.0 and got.least_recall[8] == 1.0
    assert got.probe_shards == next(p for p in (1, 2, 4, 8) if got.mean_recall[p] >= 0.9)
    for bad in ({"probes": (99,)}, {"probes": (1,), "target": 1.5}):
        with pytest.raises(ValueError):
            evaluation.calibrate(rows, queries, centers, 5, **bad)


def test_baselines(world):
    x, _, _, q, _ = world
    centers = x[:32]
    true = baselines.exhaustive(centers, q, 4)
    assert (baselines.LowRank(centers, 10).route(q, 4) == true).all()
    assert baselines.LowRank(centers, 2).route(q, 4).shape == (6, 4)
    tree = baselines.Hierarchical(centers)
    assert tree.route(q, 4).shape == (6, 4) and tree.memory_bytes > 0
    assert all(len(set(r)) == 4 for r in baselines.random_shards(32, 6, 4))
    assert (baselines.Hierarchical(centers, branching=1).route(q, 4) == true).all()


def test_lsh_is_part_of_the_exact_result(world):
    x, _, rows, q, queries = world
    got = found(local_index.lsh_topk(rows, queries, 5))
    scores = np.round(x @ q.T, 6)
    assert all(s == pytest.approx(scores[i, k]) for k, line in got.items() for i, s in line)
    exact = found(search.block_topk(rows, queries, 5))
    hits = sum(len({i for i, _ in got.get(k, [])} & {i for i, _ in line}) for k, line in exact.items())
    assert hits >= 24  # of 30
    assert local_index.chosen_backend("auto", 10**6, 10) == "lsh" and local_index.chosen_backend("auto", 100, 10) == "exact"
    with pytest.raises(ValueError):
        local_index.chosen_backend("magic", 1, 1)


def test_lsh_meets_few_rows_and_most_neighbours(spark):
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((60, 32))
    x = centers[rng.integers(0, 60, 6000)] + 0.25 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = rows.where("id % 200 = 0").withColumnRenamed("id", "query_id")
    met = local_index.lsh_candidates(rows, queries).select("query_id", "id").distinct().count()
    assert met < 0.25 * 6000 * 30
    got, exact = found(local_index.lsh_topk(rows, queries, 10)), found(search.block_topk(rows, queries, 10))
    assert sum(len({i for i, _ in got[k]} & {i for i, _ in line}) for k, line in exact.items()) >= 0.9 * 300


def test_sign_tables_probe_the_least_sure_signs_first():
    planes = np.eye(3)[None, :, :]
    tables = local_index.SignTables(planes)
    assert tables.keys(np.array([[0.1, -0.2, 0.9]]), 4).tolist() == [[[5, 4, 7, 6]]]
    assert tables.keys(np.array([[0.1, -0.2, 0.9]])).tolist() == [[[5]]]


def test_ranks_of_everything_by_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(q), int(i), float(rng.integers(0, 40)) / 40) for q in range(3) for i in range(200 * (q + 1))]
    df = spark.createDataFrame(rows, "query_id long, id long, score double")
    got = {(r["query_id"], r["id"]): r["rank"] for r in search.rank_all(df, 100).collect()}
    for q in range(3):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[q, r[1]] for r in own] == list(range(1, len(own) + 1))
    assert search.rank_all(df.limit(0)).count() == 0


def test_everything_is_ranked_without_a_shuffle_of_pairs(world, monkeypatch):
    x, _, rows, q, queries = world
    want = {i: brute(x, q[i], 80) for i in range(6)}
    with monkeypatch.context() as m:
        m.setattr(search, "rank_all", None)
        plan = search.all_ranked(rows, queries)
        assert found(plan) == want and [r["rank"] for r in plan.where("query_id = 3").orderBy("rank").collect()] == list(range(1, 81))
        m.setattr(search, "TASK_RESULTS", 80)
        assert search.all_ranked(rows, queries).rdd.getNumPartitions() == 6
        m.setattr(search, "BATCH_RESULTS", 7)
        assert found(search.all_ranked(rows, queries)) == want
        assert search.all_ranked(rows.where("id < 0"), queries).count() == search.all_ranked(rows, queries.where("query_id < 0")).count() == 0
    monkeypatch.setattr(search.query_blocks, "__defaults__", (2000,))
    assert found(search.all_ranked(rows, queries)) == want


def test_best_cells_with_ties():
    values = np.array([[1.0, 3.0, 3.0, 3.0, -np.inf], [-np.inf] * 5, [0.0, 0.0, 0.0, 0.0, 0.0]])
    row, column = search.best_cells(values, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (2, 0), (2, 1)]
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, (20, 30)).astype(float)
    row, column = search.best_cells(values, 7)
    want = np.argsort(-values, axis=1, kind="stable")[:, :7]
    assert (column.reshape(20, 7) == want).all() and (row.reshape(20, 7) == np.arange(20)[:, None]).all()


def test_scores_are_taken_in_bounded_blocks(world, monkeypatch):
    _, _, rows, _, queries = world
    want = found(search.block_topk(rows, queries, 5))
    monkeypatch.setattr(search, "CELLS", 1)
    assert found(search.block_topk(rows, queries, 5)) == want


def test_large_shards_are_split_when_written(spark):
    from tessera.operators import shards

    rows = spark.range(5000).selectExpr("id", "array(1D) as vector", "cast(if(id < 4500, 0, id % 7) as int) as shard_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = shards.dealt(rows, 500).selectExpr("shard_id", "spark_partition_id() as p")
    assert parts.where("shard_id = 0").select("p").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.dealt(rows, 500).exceptAll(rows).count() == 0 and shards.dealt(rows, 500).count() == 5000


def test_consistency(world):
    rows = world[2]
    local_index.check_consistency(rows, 8, 10)
    for n, d in ((9, 10), (7, 10), (8, 11)):
        with pytest.raises(ValueError):
            local_index.check_consistency(rows, n, d)


def test_settings_from_a_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# settings\nshards: 64\nbands: [1, 2]  # two\nprobe_shards: 4\nmax_attempts: null\nordering: 'identity'\nexact_fallback: false\n")
    c = load_config(str(path))
    assert (c.shards, c.bands, c.probe_shards, c.max_attempts, c.ordering, c.exact_fallback) == (64, (1, 2), 4, None, "identity", False)
    path.write_text("bands:\n  - 4\n  - 8\n")
    assert load_config(str(path)).bands == (4, 8)
    for bad in ("unknown: 1\n", "  nested: 1\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            load_config(str(path))
