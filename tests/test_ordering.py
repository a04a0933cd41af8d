import numpy as np
import pytest

from tessera.operators import ordering


@pytest.mark.parametrize("method", sorted(ordering.METHODS))
@pytest.mark.parametrize("shards", [1, 2, 3, 40])
def test_orders_are_permutations(method, shards):
    x = np.random.default_rng(7).standard_normal((shards, 6))
    assert sorted(ordering.build_order(x, method)) == list(range(shards))
    assert (ordering.build_order(x, method) == ordering.build_order(x, method)).all()


@pytest.mark.parametrize("method", ["recursive_pca", "nearest_neighbor_chain", "spectral_seriation", "hierarchical"])
def test_a_line_is_found(method):
    places = np.random.default_rng(3).permutation(30)
    x = np.stack([places, 0 * places], axis=1).astype(float)
    walked = np.abs(np.diff(places[ordering.build_order(x, method)]))
    assert walked.sum() <= (29 if method != "hierarchical" else 120)


def test_equal_points_keep_their_numbers():
    assert ordering.recursive_pca(np.ones((20, 3))).tolist() == list(range(20))


def test_bad_orders():
    for bad in ([0, 0, 1], [0, 1], [0, 1, 3]):
        with pytest.raises(ValueError):
            ordering.check_order(bad, 3)
    with pytest.raises(ValueError):
        ordering.build_order(np.ones((3, 2)), "alphabetical")
