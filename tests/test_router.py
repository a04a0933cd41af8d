import numpy as np
import pytest

from tessera.operators.router import Router, RouterConfig
from tessera.plans.catalogue import curve_fixture


def unit(n, d, seed=1234):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def router(n=16, d=12, **options):
    settings = {"shards": n, "bands": (1, 2, 4), "probe_shards": 3} | options
    return Router.fit(unit(n, d), RouterConfig(**settings), radii=np.full(n, 0.5))


def test_fallback_is_the_matrix_product():
    r, q = router(), unit(5, 12, 1)
    found = r.route(q)
    true = np.argsort(-(q @ r.centroids.T), axis=1, kind="stable")[:, :3]
    assert (found.shard_ids == true).all() and found.certified.all()
    assert set(found.modes) <= {"exact_fallback", "spectral_certified"}


@pytest.mark.parametrize(
    ("options", "mode", "band"),
    [
        ({"bands": (8,)}, "full_band_exact_fast_path", 8),
        ({"bands": (1, 99), "max_attempts": 0}, "cost_aware_full_band_exact_fast_path", 8),
        ({"bands": (1, 2), "max_attempts": 0}, "exact_fallback", 2),
        ({"bands": (1,), "exact_fallback": False}, "spectral_approximate", 1),
    ],
)
def test_modes(options, mode, band):
    found = router(**options).route(unit(3, 12, 2))
    assert found.modes == [mode] * 3 and (found.used_band == band).all()
    assert found.certified.all() == (mode != "spectral_approximate")
    assert found.fallback.all() == (mode == "exact_fallback")


def test_nothing_to_try_is_an_error():
    with pytest.raises(ValueError):
        router(bands=(1,), exact_fallback=False, max_attempts=0).route(unit(1, 12))


def test_certified_routes_are_exact_and_intervals_cover(spark):
    centers, _ = curve_fixture(spark)
    r = Router.fit(centers, RouterConfig(shards=64, bands=(1, 2, 4, 16), probe_shards=8, ordering="identity"))
    u = 2 * np.pi * (1.6 * np.arange(40) + 0.3) / 64
    q = np.stack([np.cos(u), np.sin(u), 0.5 * np.cos(2 * u), 0.5 * np.sin(2 * u), 0 * u, 0 * u], axis=1)
    found = r.route(q)
    unit_q = r.prepared(q)
    exact = unit_q @ centers.T
    assert ((found.lower <= exact + 1e-9) & (exact <= found.upper + 1e-9)).all()
    assert found.modes.count("spectral_certified") == 40
    best = np.sort(np.argsort(-exact, axis=1, kind="stable")[:, :8], axis=1)
    assert (np.sort(found.shard_ids, axis=1) == best).all()


def test_batch_is_the_same_as_single_and_as_the_table(spark):
    r, q = router(), unit(7, 12, 3)
    batch = r.route(q)
    for i in range(7):
        one = r.route(q[i])
        assert (one.shard_ids[0] == batch.shard_ids[i]).all() and one.modes[0] == batch.modes[i]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    rows = {x["query_id"]: x for x in r.route_table(table).collect()}
    assert all(rows[i]["shard_ids"] == batch.shard_ids[i].tolist() for i in range(7))


@pytest.mark.parametrize("bad", [np.zeros(12), np.full(12, np.nan), np.ones(5)])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        router().route(bad)


def test_bad_probe_and_settings():
    with pytest.raises(ValueError):
        router().route(unit(1, 12), 99)
    for options in ({"shards": 0}, {"metric": "manhattan"}, {"probe_shards": 0}, {"bands": (-1,)}, {"max_attempts": -1}):
        with pytest.raises(ValueError):
            RouterConfig(**options)


def test_inputs_are_not_changed():
    x = unit(16, 12) * 3
    before = x.copy()
    Router.fit(x, RouterConfig(shards=16, probe_shards=1)).updated(0, x[1])
    assert (x == before).all()


def test_incremental_update_is_a_rebuild_and_forgets_the_radius():
    r = router()
    a, b = r.updated(4, unit(1, 12, 9)[0], incremental=True), r.updated(4, unit(1, 12, 9)[0], incremental=False)
    assert np.allclose(a.spectrum, b.spectrum, atol=1e-10)
    assert all(np.allclose(a.residuals[k], b.residuals[k], atol=1e-9) for k in a.bands)
    assert np.isnan(a.radii[4]) and np.isnan(a.radii).sum() == 1 and not np.isnan(r.radii).any()


def test_maintenance():
    r = router()
    assert r.added(unit(1, 12, 8)[0]).shards == 17 and np.isnan(r.added(unit(1, 12, 8)[0]).radii[-1])
    assert np.allclose(r.removed(3).centroids, np.delete(r.centroids, 3, axis=0))
    merged = r.merged(5, 2, r.centroids[2] + r.centroids[5])
    assert merged.shards == 15 and np.isnan(merged.radii[2])
    split = r.split(1, r.centroids[1] + r.centroids[2], r.centroids[1] - r.centroids[2])
    assert split.shards == 17 and np.isnan(split.radii[[1, 16]]).all()
    for call in (lambda: r.removed(99), lambda: r.merged(1, 1, r.centroids[0]), lambda: r.updated(-1, r.centroids[0])):
        with pytest.raises(ValueError):
            call()


def test_unnormalized_intervals_cover():
    x = unit(12, 7) * 2
    r = Router.fit(x, RouterConfig(shards=12, bands=(1,), probe_shards=2, normalize=False, exact_fallback=False))
    q = unit(4, 7, 5) * 3
    found = r.route(q)
    assert ((found.lower <= q @ x.T + 1e-9) & (q @ x.T <= found.upper + 1e-9)).all()


def test_euclidean_routes_by_least_distance():
    x = unit(6, 4)
    r = Router.fit(x, RouterConfig(shards=6, bands=(1,), probe_shards=2, metric="euclidean", normalize=False), radii=np.full(6, 0.1))
    q = unit(3, 4, 7) * 2
    gap = np.linalg.norm(q[:, None] - x[None], axis=2)
    assert (r.route(q).shard_ids == np.argsort(gap, axis=1)[:, :2]).all()


def test_reports():
    stats = router().stats()
    assert stats["memory"]["total_bytes"] > 0 and stats["energy"][4] <= 1 and stats["order"]["total_variation"] > 0
