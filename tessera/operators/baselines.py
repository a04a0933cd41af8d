"""Other ways to choose shards, to compare the router with. All work on a matrix of centroids and a matrix of queries."""

from __future__ import annotations

import numpy as np

from tessera.operators.router import best_shards


def exhaustive(centroids: np.ndarray, queries: np.ndarray, probe: int) -> np.ndarray:
    return best_shards(queries @ centroids.T, probe)


def random_shards(shards: int, queries: int, probe: int, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(shards, probe, replace=False) for _ in range(queries)])


class LowRank:
    """Scores from a truncated decomposition of the centroids: of the centered ones (principal components) or as they are (truncated SVD)."""

    def __init__(self, centroids: np.ndarray, rank: int, centered: bool = True):
        self.mean = centroids.mean(axis=0) * centered
        u, s, v = np.linalg.svd(centroids - self.mean, full_matrices=False)
        keep = min(max(1, rank), len(s))
        self.left, self.right = u[:, :keep] * s[:keep], v[:keep]

    def route(self, queries: np.ndarray, probe: int) -> np.ndarray:
        return best_shards((queries @ self.right.T) @ self.left.T + (queries @ self.mean)[:, None], probe)

    @property
    def memory_bytes(self) -> int:
        return self.left.nbytes + self.right.nbytes + self.mean.nbytes


class Hierarchical:
    """Groups of shards by spherical k-means; the best groups are opened until they hold twice as many shards as are wanted."""

    def __init__(self, centroids: np.ndarray, branching: int = 16, seed: int = 42, rounds: int = 25):
        n = len(centroids)
        groups = min(max(1, int(np.ceil(np.sqrt(n)))), branching, n)
        self.centroids = centroids
        centers = centroids[np.random.default_rng(seed).choice(n, groups, replace=False)]
        for _ in range(rounds):
            self.group = (centroids @ centers.T).argmax(axis=1)
            sums = np.stack([centroids[self.group == g].sum(axis=0) if (self.group == g).any() else centers[g] for g in range(groups)])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
        self.group, self.centers = (centroids @ centers.T).argmax(axis=1), centers

    def route(self, queries: np.ndarray, probe: int) -> np.ndarray:
        rank = np.argsort(np.argsort(-(queries @ self.centers.T), axis=1, kind="stable"), axis=1, kind="stable")
        place = rank[:, self.group]  # of each shard's group in the query's order
        sizes = np.bincount(self.group, minlength=len(self.centers))
        by_rank = sizes[np.argsort(rank, axis=1)]
        opened = np.minimum((np.cumsum(by_rank, axis=1) < 2 * probe).sum(axis=1) + 1, len(self.centers))
        scores = np.where(place < opened[:, None], queries @ self.centroids.T, -np.inf)
        return best_shards(scores, probe)

    @property
    def memory_bytes(self) -> int:
        return self.centroids.nbytes + self.centers.nbytes + self.group.nbytes
