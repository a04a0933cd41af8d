"""Orders of shards in which neighbours are alike. Shards are few, so this is NumPy on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import distance

#: Seriation builds a matrix of shards by shards.
SERIATION_SHARDS = 4096


def check_order(order, shards: int) -> np.ndarray:
    out = np.asarray(order, dtype=np.int64)
    if out.shape != (shards,) or not np.array_equal(np.sort(out), np.arange(shards)):
        raise ValueError("an order must hold every shard once")
    return out


def _axis(points: np.ndarray) -> np.ndarray | None:
    """First principal direction, its largest component positive; None if the points do not spread."""
    spread = points - points.mean(axis=0)
    values, vectors = np.linalg.eigh(spread.T @ spread)
    if values[-1] <= np.finfo(float).eps:
        return None
    axis = vectors[:, -1]
    return axis * (1.0 if axis[np.abs(axis).argmax()] > 0 else -1.0)


def recursive_pca(points: np.ndarray, leaf: int = 8) -> np.ndarray:
    """Sort along the principal direction, halve, and do the same with each half down to leaves."""
    if leaf < 1:
        raise ValueError("a leaf holds at least one shard")
    out, todo = [], [np.arange(len(points))]
    while todo:  # a stack of parts, the next one in order on top
        part = todo.pop()
        axis = _axis(points[part]) if len(part) > 1 else None
        if axis is None:
            out.extend(np.sort(part))
            continue
        part = part[np.lexsort((part, points[part] @ axis))]
        if len(part) <= leaf:
            out.extend(part)
        else:
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return np.array(out, np.int64)


def nearest_chain(points: np.ndarray) -> np.ndarray:
    """From the shard with the least first coordinate always on to the nearest one left."""
    left = np.ones(len(points), bool)
    out = []
    at = int(points[:, 0].argmin()) if len(points) else 0
    for _ in range(len(points)):
        out.append(at)
        left[at] = False
        gap = np.where(left, ((points - points[at]) ** 2).sum(axis=1), np.inf)
        at = int(gap.argmin())
    return np.array(out, np.int64)


def seriation(points: np.ndarray) -> np.ndarray:
    """By the second eigenvector of the Laplacian of a Gaussian affinity whose width is the median squared distance."""
    n = len(points)
    if n > SERIATION_SHARDS:
        raise ValueError(f"seriation is limited to {SERIATION_SHARDS} shards")
    if n <= 2:
        return np.arange(n)
    square = (points**2).sum(axis=1)
    gaps = np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0)
    np.fill_diagonal(gaps, 0)
    apart = gaps[gaps > 1e-15]
    near = np.exp(-gaps / (2 * (np.median(apart) if len(apart) else 1.0)))
    np.fill_diagonal(near, 0)
    return np.lexsort((np.arange(n), np.linalg.eigh(np.diag(near.sum(axis=1)) - near)[1][:, 1]))


def average_linkage(points: np.ndarray) -> np.ndarray:
    """Leaves of the average-linkage tree: the two closest clusters merge, the one that was made first (or has the smaller shard) left."""
    n = len(points)
    if n <= 2:
        return np.arange(n)
    gap = np.sqrt(np.maximum(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(gap, np.inf)
    leaves, size, made = [[i] for i in range(n)], np.ones(n), list(range(n))
    for step in range(n - 1):
        i, j = divmod(int(gap.argmin()), n)
        if made[j] < made[i]:
            i, j = j, i
        merged = (size[i] * gap[i] + size[j] * gap[j]) / (size[i] + size[j])
        gap[i], gap[:, i] = merged, merged
        gap[j], gap[:, j], gap[i, i] = np.inf, np.inf, np.inf
        leaves[i], size[i], made[i] = leaves[i] + leaves[j], size[i] + size[j], n + step
        last = i
    return np.array(leaves[last], np.int64)


METHODS = {
    "identity": lambda p, seed: np.arange(len(p)),
    "random": lambda p, seed: np.random.default_rng(seed).permutation(len(p)),
    "recursive_pca": lambda p, seed: recursive_pca(p),
    "nearest_neighbor_chain": lambda p, seed: nearest_chain(p),
    "spectral_seriation": lambda p, seed: seriation(p),
    "hierarchical": lambda p, seed: average_linkage(p),
}


def build_order(points: np.ndarray, method: str = "recursive_pca", seed: int = 42) -> np.ndarray:
    if method not in METHODS:
        raise ValueError(f"unknown order {method}; there are {', '.join(METHODS)}")
    return check_order(METHODS[method](np.asarray(points, float), seed), len(points))


def ordering_quality(centers: DataFrame) -> DataFrame:
    """(mean, median, total) of the distances between neighbours of an ordered shard table (n, centroid)."""
    order = Window.orderBy("n")  # one row a shard
    gaps = centers.select(distance(F.col("centroid"), F.lead("centroid").over(order)).alias("gap")).where("gap is not null")
    return gaps.agg(F.avg("gap").alias("mean_distance"), F.percentile("gap", 0.5).alias("median_distance"), F.sum("gap").alias("total_variation"))
