"""The shard router: approximate scores from low frequencies, certified or widened until they are exact.

A Router does not change; updates make a new one. Routing a table of queries is one Arrow pass with the router broadcast: the batch is a matrix, and only
queries that are not settled go on to the next band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators import ordering, spectral
from tessera.operators.shards import MATRIX_BYTES

ROUTE_SCHEMA = "query_id long, shard_ids array<int>, scores array<double>, lower array<double>, upper array<double>, used_band int, certified boolean, fallback boolean, route_mode string"


@dataclass(frozen=True)
class RouterConfig:
    shards: int = 256
    bands: tuple[int, ...] = (8, 16, 32, 64, 128)
    probe_shards: int = 16
    ordering: str = "recursive_pca"
    metric: str = "cosine"
    normalize: bool = True
    exact_fallback: bool = True
    max_attempts: int | None = None
    seed: int = 42

    def __post_init__(self):
        if self.shards < 1 or not 1 <= self.probe_shards <= self.shards:
            raise ValueError("probe_shards must be between 1 and the number of shards")
        if self.metric not in ("cosine", "euclidean"):
            raise ValueError("metric must be cosine or euclidean")
        if self.max_attempts is not None and self.max_attempts < 0:
            raise ValueError("max_attempts must not be negative")
        object.__setattr__(self, "bands", tuple(sorted({int(b) for b in self.bands if int(b) >= 0})))
        if not self.bands:
            raise ValueError("at least one band is needed")


#: Queries times shards that are scored at a time.
ROUTE_CELLS = 4 << 20


@dataclass(frozen=True)
class Routes:
    """Of each query: the chosen shards, best first, all shards' scores with their bounds, and how they came about."""

    shard_ids: np.ndarray
    scores: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    used_band: np.ndarray
    certified: np.ndarray
    fallback: np.ndarray
    modes: list[str]


def best_shards(scores: np.ndarray, count: int) -> np.ndarray:
    """The best shards of each row, ties to the smaller number."""
    return np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :count]


def certified_rows(lower: np.ndarray, upper: np.ndarray, chosen: np.ndarray, slack: float = 1e-9) -> np.ndarray:
    """Whether each row's chosen shards are surely the best."""
    picked = np.zeros(lower.shape, bool)
    np.put_along_axis(picked, chosen, True, axis=1)
    if picked.all():
        return np.ones(len(lower), bool)
    return np.where(picked, lower, np.inf).min(axis=1) - np.where(picked, -np.inf, upper).max(axis=1) >= slack


def _unit(rows: np.ndarray, name: str) -> np.ndarray:
    rows = np.asarray(rows, float)
    if not np.isfinite(rows).all():
        raise ValueError(f"{name} holds values that are not finite")
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    if (lengths <= np.finfo(float).eps).any():
        raise ValueError(f"{name} holds a vector of length zero")
    return rows / lengths


@dataclass(frozen=True)
class Router:
    config: RouterConfig
    centroids: np.ndarray
    order: np.ndarray
    spectrum: np.ndarray
    residuals: dict[int, np.ndarray] = field(repr=False)
    #: Of each shard, or NaN where it must be measured again.
    radii: np.ndarray | None = None

    @classmethod
    def fit(cls, centroids: np.ndarray, config: RouterConfig, order=None, radii: np.ndarray | None = None) -> Router:
        centroids = np.array(centroids, float)
        if centroids.ndim != 2 or len(centroids) != config.shards:
            raise ValueError("there must be one centroid for each shard")
        centroids = _unit(centroids, "centroids") if config.normalize else centroids.copy()
        if not np.isfinite(centroids).all():
            raise ValueError("centroids hold values that are not finite")
        order = ordering.build_order(centroids, config.ordering, config.seed) if order is None else ordering.check_order(order, len(centroids))
        return cls._derived(config, centroids, order, np.fft.rfft(centroids[order], axis=0), radii)

    @classmethod
    def _derived(cls, config, centroids, order, spectrum, radii) -> Router:
        gaps = {}
        for band in spectral.clean_bands(config.bands, len(centroids)):
            gap = np.zeros(len(centroids))
            if band < spectral.full_band(len(centroids)):
                gap[order] = np.linalg.norm(centroids[order] - spectral.rebuild(spectrum, len(centroids), band), axis=1)
            gaps[band] = gap
        return cls(config, centroids, order, spectrum, gaps, None if radii is None else np.array(radii, float))

    @property
    def shards(self) -> int:
        return len(self.centroids)

    @property
    def bands(self) -> tuple[int, ...]:
        return tuple(self.residuals)

    def prepared(self, queries: np.ndarray) -> np.ndarray:
        queries = np.atleast_2d(np.array(queries, float))
        if queries.shape[1] != self.centroids.shape[1]:
            raise ValueError(f"a query must have {self.centroids.shape[1]} components")
        unit = _unit(queries, "queries")
        return unit if self.config.normalize else queries

    def exact_scores(self, queries: np.ndarray) -> np.ndarray:
        """Higher is better: inner products, or for the euclidean metric the negative of the least distance a member can have."""
        if self.config.metric == "cosine":
            return queries @ self.centroids.T
        gap = np.sqrt(np.maximum((queries**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1)[None, :] - 2 * queries @ self.centroids.T, 0))
        return -np.maximum(gap - (0 if self.radii is None else np.nan_to_num(self.radii)[None, :]), 0)

    def approximate_scores(self, queries: np.ndarray, band: int) -> np.ndarray:
        kept = np.zeros((spectral.full_band(self.shards) + 1, len(queries)), complex)
        kept[: band + 1] = self.spectrum[: band + 1] @ queries.T
        out = np.empty((len(queries), self.shards))
        out[:, self.order] = np.fft.irfft(kept, n=self.shards, axis=0).T
        return out

    def exact_route(self, queries: np.ndarray, probe: int | None = None) -> Routes:
        return self._route(self.prepared(queries), self._probe(probe), only_exact=True)

    def route(self, queries: np.ndarray, probe: int | None = None) -> Routes:
        """Route a matrix of queries; a single one is a matrix of one row."""
        return self._route(self.prepared(queries), self._probe(probe), only_exact=self.config.metric != "cosine")

    @property
    def some_queries(self) -> int:
        """How many queries are routed at a time: each takes some matrices with a column a shard."""
        return max(1, ROUTE_CELLS // self.shards)

    def _probe(self, probe: int | None) -> int:
        count = self.config.probe_shards if probe is None else int(probe)
        if not 1 <= count <= self.shards:
            raise ValueError(f"probe_shards must be between 1 and {self.shards}")
        return count

    def _plan(self) -> tuple[list[int], str, int]:
        """(bands to try, what follows if none certifies, the band to report for it)."""
        full, tried = spectral.full_band(self.shards), []
        for band in self.bands:
            if band >= full:
                return tried, "full_band_exact_fast_path", band
            if self.config.max_attempts is not None and len(tried) >= self.config.max_attempts:
                if full in self.bands:
                    return tried, "cost_aware_full_band_exact_fast_path", full
                break
            tried.append(band)
        if self.config.exact_fallback:
            return tried, "exact_fallback", self.bands[-1]
        if not tried:
            raise ValueError("nothing can be routed: allow the fallback, the full band or more attempts")
        return tried, "spectral_approximate", tried[-1]

    def _route(self, queries: np.ndarray, probe: int, only_exact: bool) -> Routes:
        n, s = len(queries), self.shards
        scores, lower, upper = np.empty((n, s)), np.empty((n, s)), np.empty((n, s))
        band_of, sure, fell, modes = np.zeros(n, int), np.ones(n, bool), np.zeros(n, bool), [""] * n
        chosen = np.empty((n, probe), int)
        tried, after, last = ([], "exact_route", 0) if only_exact else self._plan()
        open_ = np.arange(n)
        norms = np.linalg.norm(queries, axis=1)
        for band in tried:
            if not len(open_):
                break
            got = self.approximate_scores(queries[open_], band)
            width = norms[open_][:, None] * self.residuals[band][None, :]
            picks = best_shards(got, probe)
            good = certified_rows(got - width, got + width, picks)
            scores[open_], lower[open_], upper[open_], chosen[open_], band_of[open_] = got, got - width, got + width, picks, band
            for i in open_[good]:
                modes[i] = "spectral_certified"
            open_ = open_[~good]
        if len(open_) and after == "spectral_approximate":
            sure[open_] = False
        elif len(open_):
            got = self.exact_scores(queries[open_])
            scores[open_] = lower[open_] = upper[open_] = got
            chosen[open_], band_of[open_] = best_shards(got, probe), last
            fell[open_] = after == "exact_fallback"
        for i in open_:
            modes[i] = after
        return Routes(chosen, scores, lower, upper, band_of, sure, fell, modes)

    def route_table(self, queries: DataFrame, probe: int | None = None) -> DataFrame:
        """queries (query_id, vector) -> a row per query, see ROUTE_SCHEMA."""
        if self.centroids.nbytes > MATRIX_BYTES:
            raise ValueError("the router is too large to broadcast")
        self._probe(probe)
        sent = queries.sparkSession.sparkContext.broadcast(self)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for lo in range(0, len(frame), sent.value.some_queries):
                    some = frame.iloc[lo : lo + sent.value.some_queries]
                    r = sent.value.route(np.stack(some["vector"].to_numpy()), probe)
                    yield pd.DataFrame({"query_id": some["query_id"].to_numpy(), "shard_ids": list(r.shard_ids), "scores": list(r.scores), "lower": list(r.lower), "upper": list(r.upper), "used_band": r.used_band, "certified": r.certified, "fallback": r.fallback, "route_mode": r.modes})

        return queries.select("query_id", "vector").mapInPandas(run, ROUTE_SCHEMA)

    # Maintenance: every change makes a new router; a changed shard's radius is unknown until it is measured.

    def updated(self, shard: int, centroid: np.ndarray, incremental: bool = True) -> Router:
        self._known(shard)
        new = np.array(centroid, float)
        if new.shape != self.centroids.shape[1:] or not np.isfinite(new).all():
            raise ValueError("a centroid must have the router's dimension and finite components")
        new = _unit(new[None, :], "centroid")[0] if self.config.normalize else new
        centroids = self.centroids.copy()
        centroids[shard] = new
        radii = self._unknown([shard])
        if not incremental:
            return Router._derived(self.config, centroids, self.order, np.fft.rfft(centroids[self.order], axis=0), radii)
        place = int(np.flatnonzero(self.order == shard)[0])
        moved = spectral.moved_spectrum(self.spectrum, place, new - self.centroids[shard], self.shards)
        return Router._derived(self.config, centroids, self.order, moved, radii)

    def added(self, centroid: np.ndarray, radius: float | None = None) -> Router:
        radii = None if self.radii is None else np.append(self.radii, np.nan if radius is None else radius)
        return self._refit(np.vstack([self.centroids, np.asarray(centroid, float)[None, :]]), radii)

    def removed(self, shard: int) -> Router:
        """Later shards move up by one number."""
        self._known(shard)
        if self.shards == 1:
            raise ValueError("the last shard can not go")
        return self._refit(np.delete(self.centroids, shard, axis=0), None if self.radii is None else np.delete(self.radii, shard))

    def split(self, shard: int, first: np.ndarray, second: np.ndarray) -> Router:
        """The first part keeps the number, the second is added."""
        return self.updated(shard, first, incremental=False).added(second)

    def merged(self, first: int, second: int, centroid: np.ndarray) -> Router:
        """The smaller number stays, the larger goes."""
        if first == second:
            raise ValueError("two different shards are needed")
        return self.updated(min(first, second), centroid, incremental=False).removed(max(first, second))

    def _known(self, shard: int) -> None:
        if not 0 <= shard < self.shards:
            raise ValueError(f"there is no shard {shard}")

    def _unknown(self, shards: list[int]) -> np.ndarray | None:
        if self.radii is None:
            return None
        out = self.radii.copy()
        out[shards] = np.nan
        return out

    def _refit(self, centroids: np.ndarray, radii) -> Router:
        config = replace(self.config, shards=len(centroids), probe_shards=min(self.config.probe_shards, len(centroids)))
        return Router.fit(centroids, config, radii=radii)

    # Reports

    def memory_report(self) -> dict[str, int]:
        top = max((b for b in self.bands if b < spectral.full_band(self.shards)), default=-1)
        parts = {"centroid_bytes": self.centroids.nbytes, "spectral_bytes": (top + 1) * self.centroids.shape[1] * 16, "residual_bytes": sum(r.nbytes for r in self.residuals.values()), "order_bytes": self.order.nbytes}
        return parts | {"total_bytes": sum(parts.values())}

    def energy_report(self) -> dict[int, float]:
        return {b: spectral.energy_fraction(self.centroids[self.order], b) for b in self.bands}

    def ordering_report(self) -> dict[str, float]:
        gaps = np.linalg.norm(np.diff(self.centroids[self.order], axis=0), axis=1)
        return {"mean_distance": float(gaps.mean()) if len(gaps) else 0.0, "median_distance": float(np.median(gaps)) if len(gaps) else 0.0, "total_variation": float(gaps.sum())}

    def stats(self) -> dict:
        return {"shards": self.shards, "dimension": self.centroids.shape[1], "bands": list(self.bands), "ordering": self.config.ordering, "metric": self.config.metric, "memory": self.memory_report(), "energy": self.energy_report(), "order": self.ordering_report()}
