import numpy as np
import pytest

from tessera.operators import spectral


def unit(n, d, seed=1234):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("shards", [1, 2, 7, 16, 17])
def test_full_band_rebuilds(shards):
    x = unit(shards, 5)
    full = spectral.full_band(shards)
    assert np.allclose(spectral.rebuild(spectral.half_spectrum(x), shards, full), x, atol=1e-9)
    assert spectral.energy_fraction(x, full) == pytest.approx(1)
    assert np.allclose(spectral.residual_norms(x, full), 0, atol=1e-9)


def test_bands_are_clamped_and_unique():
    assert spectral.clean_bands((9, 2, 2, -4, 100), 10) == (0, 2, 5)
    with pytest.raises(ValueError):
        spectral.clean_bands((), 10)


def test_band_frequencies_of_odd_and_even_counts():
    assert spectral.band_frequencies(8, 4) == list(range(8))
    assert spectral.band_frequencies(7, 3) == list(range(7))
    assert spectral.band_frequencies(8, 1) == [0, 1, 7]
    assert spectral.band_frequencies(8, 0) == [0]


def test_energy_grows_with_the_band():
    x = unit(16, 12)
    shares = [spectral.energy_fraction(x, b) for b in range(9)]
    assert shares == sorted(shares) and shares[-1] == pytest.approx(1)


def test_moved_spectrum_is_the_new_one():
    x = unit(16, 12)
    y = x.copy()
    y[5] = x[3]
    moved = spectral.moved_spectrum(spectral.half_spectrum(x), 5, y[5] - x[5], 16)
    assert np.allclose(moved, spectral.half_spectrum(y), atol=1e-10)


def test_tables_agree_with_numpy(spark):
    x = unit(9, 4)
    centers = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "n int, centroid array<double>")
    long = spectral.long_form(centers)
    spec = spectral.spectrum(long, 9)
    for r in spec.collect():
        z = spectral.half_spectrum(x)[r["k"], r["i"]]
        assert r["re"] == pytest.approx(z.real, abs=1e-9) and r["im"] == pytest.approx(z.imag, abs=1e-9)
    gaps = spectral.residuals(long, spectral.reconstruct(spec, 9, (0, 2, 4))).collect()
    assert len(gaps) == 27
    for r in gaps:
        assert r["residual"] == pytest.approx(spectral.residual_norms(x, r["band"])[r["n"]], abs=1e-9)


def test_certificates(spark):
    rows = [(0, 1, n, s, s - w, s + w) for n, (s, w) in enumerate([(0.9, 0.1), (0.5, 0.1), (0.1, 0.1)])]
    rows += [(1, 1, n, s, s - 0.3, s + 0.3) for n, s in enumerate([0.9, 0.5, 0.1])]
    bounds = spark.createDataFrame(rows, "query_id int, band int, n int, score double, lower double, upper double")
    found = {r["query_id"]: r for r in spectral.certify(bounds, 1).collect()}
    assert found[0]["certified"] and found[0]["shards"] == [0] and found[0]["margin"] == pytest.approx(0.2)
    assert not found[1]["certified"]
    everything = spectral.certify(bounds, 3).first()
    assert everything["certified"] and everything["margin"] is None
