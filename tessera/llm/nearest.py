"""Approximate nearest neighbours by shifted space-filling curves.

Each of CURVES curves has its own random orthonormal projection to DIMENSIONS numbers and its own shift; a vector's key on it is its place on the
Hilbert curve through the shifted grid, with a hash of the id below it so that equal keys still spread. A key's position is the share of rows
before it, interpolated between KNOTS quantiles of a sample, so a curve can be cut into any number of ranges of about RANGE_ROWS rows without
a table of bounds. Range by range the rows go to one group; a query goes to the ranges that its window touches, on every curve. A group is
sorted by position, queries first, and is read in segments of SEGMENT rows: each query is scored against the rows inside its window only, exactly and in
double precision, and the best k of a segment are returned; the merge over curves drops repeats and ranks. So memory does not depend on how many rows
fall into a range.

How far a neighbour lies along a curve depends on the data: a few rows where vectors cluster, a part of the curve where they are spread evenly in
many dimensions. So the half width of the windows is fitted: for PROBES vectors the true neighbours are found by a scan, and the smallest
half width is taken at which a share of at least RECALL of them lies within it on some curve. The fit reads all rows once, sends PROBES * k
rows to the driver, and behaves alike at every size. A query is scored against CURVES * 2 * half width of all rows at most.

Bounds: the sample that fits the curves has about SAMPLE rows and the probes about PROBES (twice that at most); every row is indexed.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part; rows
with equal ids are one candidate, the nearest of them (as are queries with equal ids), and an id is never its own neighbour; ties go to the smaller id;
distances of huge or tiny components are scaled before they are squared; with fewer than k candidates all are returned; a table of at most RANGE_ROWS rows is
searched whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.shared import materialise, shuffle_partitions, tune

CURVES = 16
DIMENSIONS = 6
BITS = 6
RANGE_ROWS = 1024
SEGMENT = 4096
SAMPLE = 1 << 15
KNOTS = 1 << 12
PROBES = 200
RECALL = 0.95
SEED = 7


def usable(vector: Column, dimension: int) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers below 2**bits, by Skilling's transposition."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b) & np.uint64(1))
    return key


class Curves:
    """The fitted curves: projections, shifts, the grid's scale, and quantiles of each curve's keys."""

    def __init__(self, sample: np.ndarray, rows: int, curves: int = CURVES, dimensions: int = DIMENSIONS, range_rows: int = RANGE_ROWS):
        rng = np.random.default_rng(SEED)
        dimension = sample.shape[1]
        m = min(dimensions, dimension)
        self.projections = np.stack([np.linalg.qr(rng.standard_normal((dimension, m)))[0] for _ in range(curves)])
        self.unit = max(float(np.abs(sample).max()), 1e-300)  # so that huge components stay finite
        sample = sample / self.unit
        self.centre = sample.mean(axis=0)
        self.scale = max(float(np.quantile(np.abs((sample - self.centre) @ self.projections[0]), 0.99)), 1e-12)
        self.shifts = rng.uniform(-0.35, 0.35, (curves, m))
        self.ranges = max(1, -(-rows // range_rows))
        keys = np.sort(self.keys(sample * self.unit, np.arange(len(sample))), axis=1).astype(np.float64)
        at = np.linspace(0, len(sample) - 1, min(KNOTS, len(sample))).astype(np.int64)
        self.knots, self.shares = keys[:, at], (at + 0.5) / len(sample)

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(curves, rows) keys below 2**52: the place on the curve and 16 bits of a hash of the id."""
        salt = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        flat = vectors / self.unit - self.centre
        out = []
        for projection, shift in zip(self.projections, self.shifts, strict=True):
            grid = (np.clip(flat @ projection / self.scale, -1e6, 1e6) + shift) * 0.4 + 0.5
            cells = np.clip((grid * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            out.append(hilbert(cells) << np.uint64(16) | salt)
        return np.stack(out)

    def positions(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(curves, rows) shares of all rows that come before."""
        return np.stack([np.interp(k.astype(np.float64), x, self.shares) for k, x in zip(self.keys(vectors, ids), self.knots, strict=True)])

    def places(self, positions: np.ndarray) -> np.ndarray:
        """Numbers of ranges."""
        return np.clip((positions * self.ranges).astype(np.int64), 0, self.ranges - 1)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def exact_distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences; scaled where squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        d = vectors - query
        out = np.sqrt((d * d).sum(axis=1))
        largest = np.abs(d).max(axis=1, initial=0)
        odd = (largest > 0) & ((largest > 1e150) | (largest < 1e-150))
        if odd.any():
            unit = largest[odd]
            out[odd] = unit * np.sqrt(((d[odd] / unit[:, None]) ** 2).sum(axis=1))
    return out


def best(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: int, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest by exact distance, then id. rough: squared distances up to rounding, infinite for rows that are out; only rows
    near the k-th are measured, and all if a rough one is not a number."""
    out = (ids == own) | (rough == np.inf)
    if len(rough) > k and not np.isnan(rough).any():
        rough = np.where(out, np.inf, rough)
        limit = np.partition(rough, k - 1)[k - 1]
        near = np.flatnonzero(~out & (rough <= limit + 1e-9 * (1 + abs(limit)) + 1e-6 * np.abs(query).max() ** 2))
    else:
        near = np.flatnonzero(~out)
    distance = exact_distances(query, vectors[near])
    order = np.lexsort((ids[near], distance))[:k]
    return ids[near][order], distance[order]


def _rough(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances up to rounding; not numbers where squares leave the range of doubles."""
    if max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) > 1e150:
        return np.full((len(queries), len(vectors)), np.nan)
    return (queries * queries).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1)[None, :] - 2 * queries @ vectors.T


_FOUND = "query_id long, vec_id long, score double"


def scan_neighbours(rows: DataFrame, probes: pd.DataFrame, k: int) -> DataFrame:
    """The true neighbours of a few probes (vec_id, vector): each batch's best k, merged by query."""
    wanted, own = _matrix(probes["vector"]), probes["vec_id"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors, ids = _matrix(pdf["vector"]), pdf["vec_id"].to_numpy()
                rough = _rough(wanted, vectors)
                parts = [(q, *best(wanted[i], vectors, ids, q, rough[i], k)) for i, q in enumerate(own)]
                yield pd.DataFrame({"query_id": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]), "vec_id": np.concatenate([p[1] for p in parts]), "score": np.concatenate([p[2] for p in parts])})

    return ranked(rows.mapInPandas(scan, _FOUND), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, each id once."""
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sampled(rows: DataFrame, count: int, most: int, salt: int) -> pd.DataFrame:
    """About `most` rows (twice that at most) by a hash of id and vector; where many rows are alike and none is met, the first ones."""
    share = min(1.0, most / max(count, 1))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = picked.limit(2 * most).toPandas()
    return (found if len(found) else rows.limit(most).toPandas()).sort_values("vec_id", kind="stable", ignore_index=True)


def fitted(rows: DataFrame, k: int, recall: float = RECALL, probes: int = PROBES, **sizes) -> tuple[Curves, float]:
    """The curves and the half width of the windows for rows (vec_id, vector)."""
    count = rows.count()
    curves = Curves(_matrix(_sampled(rows, count, SAMPLE, 1)["vector"]), count, **sizes)
    if curves.ranges == 1:
        return curves, 1.0
    few = _sampled(rows, count, probes, 2).drop_duplicates("vec_id")
    near = materialise(scan_neighbours(rows, few, k).select("query_id", "vec_id"), "probe-neighbours")  # probes * k rows
    vectors = rows.join(near.select("vec_id").distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"]).toPandas().set_index("vec_id")
    pairs = near.toPandas()
    at = lambda df, ids: pd.Series(list(curves.positions(_matrix(df["vector"]), ids).T), ids)
    of_neighbours, of_probes = at(vectors, vectors.index.to_numpy()), at(few, few["vec_id"].to_numpy())
    apart = np.abs(np.stack(pairs["query_id"].map(of_probes)) - np.stack(pairs["vec_id"].map(of_neighbours))).min(axis=1)
    return curves, float(np.quantile(apart, recall, method="higher"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding", **sizes) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row that is_query holds for."""
    spark = vectors.sparkSession
    tune(spark)
    # floats stay floats while they move, which is exact and half as much; all arithmetic is double
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(kind).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    named = named.where("vec_id is not null and vector is not null")
    lengths = named.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dimension = lengths["size"] if lengths else 0
    rows = named.where(usable(F.col("vector"), dimension))
    if rows.limit(1).count() == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves, half = fitted(rows.select("vec_id", "vector"), k, recall, **sizes)
    sent = spark.sparkContext.broadcast(curves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asked = np.asarray(batch.column("vec_id")), np.asarray(batch.column("is_query").to_numpy(zero_copy_only=False), bool)
            x = np.asarray(batch.column("vector").flatten()).reshape(len(ids), -1)
            q = np.flatnonzero(asked)
            for curve, position in enumerate(c.positions(x.astype(np.float64), ids)):
                first, last = c.places(position[q] - half), c.places(position[q] + half)
                touched = textkit.gather_ranges(first, last - first + 1)
                at = np.concatenate([np.arange(len(ids)), np.repeat(q, last - first + 1)])
                for lo in range(0, len(at), SEGMENT):
                    own = at[lo : lo + SEGMENT]
                    vector = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(own) + 1) * x.shape[1], x.shape[1], dtype=np.int32)), pa.array(x[own].reshape(-1)))
                    place = np.concatenate([c.places(position), touched])[lo : lo + SEGMENT]
                    yield pa.RecordBatch.from_pydict(
                        {"curve": pa.array(np.full(len(own), curve, np.int32)), "place": pa.array(place), "asks": pa.array(np.arange(lo, lo + len(own)) >= len(ids)), "position": pa.array(position[own]), "vec_id": pa.array(ids[own]), "vector": vector}
                    )

    dealt = rows.mapInArrow(deal, f"curve int, place long, asks boolean, position double, vec_id long, vector {kind}")
    parts = max(shuffle_partitions(spark), min(len(curves.knots) * curves.ranges // 8, 8 * shuffle_partitions(spark)))
    dealt = dealt.repartition(parts, "curve", "place").sortWithinPartitions("curve", "place", F.desc("asks"), "position")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, held, size = None, [], [], 0

        def close() -> pa.RecordBatch | None:
            """The best of the held rows for the group's queries."""
            nonlocal size
            if not asked or not held:
                held.clear()
                size = 0
                return None
            if len(asked) > 1:
                asked[:] = [tuple(np.concatenate(v) for v in zip(*asked, strict=True))]
            own, queries, centre = asked[0]
            ids, x, position = (np.concatenate(v) for v in zip(*held, strict=True))
            x = x.astype(np.float64)
            held.clear()
            size = 0
            first, last = np.searchsorted(position, centre - half, "left"), np.searchsorted(position, centre + half, "right")
            out = []
            hits = np.flatnonzero(last > first)
            for lo in range(0, len(hits), 256):
                some = hits[lo : lo + 256]
                a, b = int(first[some].min()), int(last[some].max())
                rough = _rough(queries[some].astype(np.float64), x[a:b])
                place = np.arange(a, b)
                rough[(place[None, :] < first[some][:, None]) | (place[None, :] >= last[some][:, None])] = np.inf
                out += [(own[i], *best(queries[i].astype(np.float64), x[a:b], ids[a:b], own[i], rough[n], k)) for n, i in enumerate(some)]
            if not out:
                return None
            return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat([p[0] for p in out], [len(p[1]) for p in out]).astype(np.int64)), "vec_id": pa.array(np.concatenate([p[1] for p in out])), "score": pa.array(np.concatenate([p[2] for p in out]))})

        for batch in batches:
            if not batch.num_rows:
                continue
            curve, place, asks = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("curve", "place", "asks"))
            cuts = np.flatnonzero((np.diff(curve) != 0) | (np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            x = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
            ids, position = np.asarray(batch.column("vec_id")), np.asarray(batch.column("position"))
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if group != (curve[a], place[a]) or size >= SEGMENT:
                    if (made := close()) is not None:
                        yield made
                if group != (curve[a], place[a]):
                    asked.clear()
                    group = (curve[a], place[a])
                if asks[a]:
                    asked.append((ids[a:b], x[a:b], position[a:b]))
                else:
                    held.append((ids[a:b], x[a:b], position[a:b]))
                    size += b - a
        if (made := close()) is not None:
            yield made

    found = ranked(dealt.mapInArrow(score, _FOUND), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def reference_nearest(ids: np.ndarray, vectors: np.ndarray, own: int, k: int = 10) -> list[tuple[int, float]]:
    """Brute force for one query, for tests."""
    i = int(np.flatnonzero(ids == own)[0])
    others = ids != own
    distance = exact_distances(vectors[i].astype(np.float64), vectors[others].astype(np.float64))
    order = np.lexsort((ids[others], distance))[:k]
    return [(int(a), float(d)) for a, d in zip(ids[others][order], distance[order], strict=True)]
