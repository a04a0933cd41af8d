"""Search inside shards: exact by default, approximate by random projections on request.

The exact form is the block scan of operators.search. The approximate one gives each vector, in each of several tables, a key of the signs of random
projections. The number of signs follows the rows (a bucket holds about BUCKET_ROWS of evenly spread vectors), and a query also looks into the buckets that differ in
the few signs it is least sure of, so a query meets about tables * probes * BUCKET_ROWS rows whatever the table's size. Queries are joined with
the rows of equal shard, table and key, by hash partitioning; rows are scored in the join and only each query's best are shuffled on. The form is always
labelled, and recall is to be measured against the exact form. `auto` takes the approximate form for shards of APPROXIMATE_ROWS rows on average and more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot
from tessera.operators import search

#: The other two are names of approximate indexes of other engines, taken as lsh.
BACKENDS = ("exact", "lsh", "auto", "hnsw", "faiss")
APPROXIMATE_ROWS = 10_000
BUCKET_ROWS = 32


def checked_backend(backend: str) -> str:
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}; there are {', '.join(BACKENDS)}")
    return "lsh" if backend in ("hnsw", "faiss") else backend


def chosen_backend(backend: str, rows: int, shards: int) -> str:
    backend = checked_backend(backend)
    return backend if backend != "auto" else "lsh" if rows / max(1, shards) >= APPROXIMATE_ROWS else "exact"


@dataclass(frozen=True)
class SignTables:
    """Random hyperplanes: tables of `bits` each."""

    planes: np.ndarray  # tables, bits, dimension

    @classmethod
    def fit(cls, rows: int, dimension: int, tables: int, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> SignTables:
        return cls.of(tables, min(30, max(1, round(math.log2(max(2.0, rows / bucket_rows))))), dimension, seed)

    @classmethod
    def of(cls, tables: int, bits: int, dimension: int, seed: int) -> SignTables:
        """The same planes for the same numbers, so a stored index keeps the numbers only."""
        return cls(np.random.default_rng(seed).standard_normal((tables, bits, dimension)))

    def keys(self, vectors: np.ndarray, probes: int = 1) -> np.ndarray:
        """(rows, tables, probes) keys: a vector's own, then those with the signs flipped that cost the least."""
        tables, bits, _ = self.planes.shape
        margin = np.einsum("nd,tbd->ntb", vectors, self.planes)
        own = ((margin > 0) * (1 << np.arange(bits))).sum(axis=2)
        if probes == 1:
            return own[:, :, None]
        width = min(bits, max(1, math.ceil(math.log2(probes)) + 1))
        near = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :width]
        flips = ((np.arange(1 << width)[:, None] >> np.arange(width)) & 1).astype(float)  # sets of the least sure signs
        cost = np.take_along_axis(np.abs(margin), near, axis=2) @ flips.T
        chosen = np.argsort(cost, axis=2, kind="stable")[:, :, : min(probes, 1 << width)]
        masks = ((1 << near)[:, :, None, :] * flips[chosen].astype(np.int64)).sum(axis=3)
        return own[:, :, None] ^ masks


def _keyed(df: DataFrame, tables: SignTables, probes: int) -> DataFrame:
    """df with a row for each table and key: `bucket` is the table's number above the key."""
    sent = df.sparkSession.sparkContext.broadcast(tables)

    def add(frames):
        for frame in frames:
            if len(frame):
                keys = sent.value.keys(np.stack(frame["vector"].to_numpy()).astype(float), probes)
                places = keys + (np.arange(keys.shape[1]) << 32)[None, :, None]
                yield frame.assign(buckets=list(places.reshape(len(frame), -1)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(add, f"{schema}, buckets array<long>").withColumn("bucket", F.explode("buckets")).drop("buckets")


def lsh_candidates(rows: DataFrame, queries: DataFrame, tables: int = 8, probes: int = 4, seed: int = 42, bucket_rows: int = BUCKET_ROWS, routes: DataFrame | None = None) -> DataFrame:
    """(query_id, id, vector, q): rows that share a bucket with a query; a pair may repeat. routes: (query_id, shard_id), then only those shards count."""
    first = rows.select(F.size("vector")).first()
    planes = SignTables.fit(rows.count(), first[0] if first else 1, tables, seed, bucket_rows)
    asked = _keyed(queries.select("query_id", "vector"), planes, probes).select("query_id", "bucket", F.col("vector").alias("q"))
    keep, on = ["id", "vector"], ["bucket"]
    if routes is not None:
        asked, keep, on = asked.join(routes, "query_id"), [*keep, "shard_id"], [*on, "shard_id"]
    return _keyed(rows.select(*keep), planes, 1).join(asked, on).select("query_id", "id", "vector", "q")


def lsh_topk(rows: DataFrame, queries: DataFrame, k: int, tables: int = 8, probes: int = 4, seed: int = 42, bucket_rows: int = BUCKET_ROWS, routes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score) among the rows that share a bucket with the query; rows (id, vector[, shard_id]), queries (query_id, vector), unit vectors."""
    met = lsh_candidates(rows, queries, tables, probes, seed, bucket_rows, routes)
    scored = met.select("query_id", "id", (F.round(dot(F.col("vector"), F.col("q")), search.DECIMALS) + F.lit(0.0)).alias("score"))
    return search.top(scored.distinct(), k)


def write_index(rows: DataFrame, path: str, tables: int = 8, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> dict:
    """Store the keys of rows (id, vector, shard_id) below path, a folder a shard; returns the numbers that the planes follow from."""
    first, count = rows.select(F.size("vector")).first(), rows.count()
    planes = SignTables.fit(count, first[0] if first else 1, tables, seed, bucket_rows)
    keyed = _keyed(rows.select("id", "vector", "shard_id"), planes, 1).select("shard_id", "bucket", "id")
    keyed.repartition("shard_id", "bucket").sortWithinPartitions("shard_id", "bucket").write.mode("overwrite").partitionBy("shard_id").parquet(path)
    return {"tables": tables, "bits": planes.planes.shape[1], "dimension": planes.planes.shape[2], "seed": seed, "entries": count * tables}


def stored_topk(index: DataFrame, numbers: dict, rows: DataFrame, queries: DataFrame, k: int, routes: DataFrame, probes: int = 4) -> DataFrame:
    """lsh_topk by a stored index (shard_id, bucket, id): only the folders of routed shards are read, and vectors of the rows that were met."""
    planes = SignTables.of(*[numbers[x] for x in ("tables", "bits", "dimension", "seed")])
    asked = _keyed(queries.select("query_id", "vector"), planes, probes).select("query_id", "bucket", F.col("vector").alias("q"))
    met = index.join(asked.drop("q").join(routes, "query_id"), ["shard_id", "bucket"]).select("query_id", "id").distinct()
    scored = met.join(rows.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    return search.top(scored.select("query_id", "id", (F.round(dot(F.col("vector"), F.col("q")), search.DECIMALS) + F.lit(0.0)).alias("score")), k)


def check_consistency(rows: DataFrame, shard_count: int, dimension: int) -> None:
    """Every shard has rows, no row is in another, and all vectors have the router's dimension."""
    found = rows.agg(F.collect_set(F.when(F.col("shard_id").between(0, shard_count - 1), F.col("shard_id"))).alias("s"), F.count_if(~F.col("shard_id").between(0, shard_count - 1)).alias("strange"), F.count_if(F.size("vector") != dimension).alias("wrong")).first()
    missing = sorted(set(range(shard_count)) - set(found["s"]))
    if missing or found["strange"] or found["wrong"]:
        raise ValueError(f"shards without rows: {missing[:5]}; rows in unknown shards: {found['strange']}; vectors of another dimension: {found['wrong']}")
