"""Shards of a vector table: clustering, repair of empty clusters, centroids, radii and metadata.

A vector table has (id, vector, shard_id); vectors are arrays of doubles. A shard table has a row per shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import clip, distance, dot, is_valid, mean_vector, normalized

#: A matrix of shards or queries that goes to the driver or is broadcast may have so many bytes.
MATRIX_BYTES = 256 << 20


def valid_vectors(df: DataFrame, id_column: str, vector_column: str, *keep: str) -> DataFrame:
    """(id, vector, ...) of the rows whose vector is usable, scaled to unit length."""
    v = F.col(vector_column).cast("array<double>")
    return df.where(is_valid(v)).select(F.col(id_column).alias("id"), normalized(v).alias("vector"), *keep)


def shard_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard_id").agg(F.count("*").alias("item_count"))


def centroids(rows: DataFrame) -> DataFrame:
    """(shard_id, item_count, centroid): the mean of a shard's vectors, scaled to unit length."""
    means = rows.groupBy("shard_id").agg(F.count("*").alias("item_count"), mean_vector("vector").alias("mean"))
    return means.select("shard_id", "item_count", normalized(F.col("mean")).alias("centroid"))


def radii(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(shard_id, euclidean_radius, angular_radius): the farthest member from the unit centroid, by distance and by angle."""
    joined = rows.join(centers.select("shard_id", "centroid"), "shard_id")
    angle = F.acos(clip(dot(F.col("vector"), F.col("centroid")), -1.0, 1.0))
    return joined.groupBy("shard_id").agg(F.max(distance(F.col("vector"), F.col("centroid"))).alias("euclidean_radius"), F.max(angle).alias("angular_radius"))


def shard_table(rows: DataFrame, root: str = "vectors") -> DataFrame:
    """(shard_id, item_count, centroid, euclidean_radius, angular_radius, path)."""
    centers = centroids(rows)
    path = F.concat(F.lit(f"{root}/shard_id="), F.col("shard_id").cast("string"))
    return centers.join(radii(rows, centers), "shard_id").withColumn("path", path)


def matrix(df: DataFrame, key: str, vector: str, limit: int = MATRIX_BYTES) -> tuple[list, np.ndarray]:
    """Keys and vectors on the driver, in key order. Larger tables than the limit are an error, not a risk."""
    first = df.select(F.size(vector)).first()
    rows = max(1, limit // (8 * max(1, first[0]))) if first else 0
    found = df.select(key, vector).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {limit} bytes of vectors")
    found.sort(key=lambda r: r[0])
    return [r[0] for r in found], np.array([r[1] for r in found], float).reshape(len(found), -1)


#: Rows of a shard that go to one task, and so to one file, when a vector table is written.
FILE_ROWS = 500_000


def dealt(rows: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """rows laid out for a table partitioned by shard: a shard's rows lie together, but a large one is split among tasks by a hash of the id."""
    parts = shard_counts(rows).select(F.col("shard_id").alias("dealt_shard"), F.ceil(F.col("item_count") / F.lit(file_rows)).alias("dealt_parts"))
    joined = rows.join(parts, rows["shard_id"] == parts["dealt_shard"])
    return joined.repartition("shard_id", F.pmod(F.xxhash64("id"), F.col("dealt_parts"))).select(*rows.columns)


def assign(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """rows with the nearest center's number as shard_id and its similarity; centers are unit vectors, broadcast within MATRIX_BYTES."""
    if centers.nbytes > MATRIX_BYTES:
        raise ValueError("too many centers to broadcast")
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def nearest(frames):
        for frame in frames:
            if len(frame):
                scores = np.stack(frame["vector"].to_numpy()).astype(float) @ sent.value.T
                best = scores.argmax(axis=1)
                yield frame.assign(shard_id=best.astype("int32"), similarity=scores[np.arange(len(best)), best])

    kept = [c for c in rows.columns if c not in ("shard_id", "similarity")]
    base = rows.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInPandas(nearest, f"{schema}, shard_id int, similarity double")


def repair_empty(assigned: DataFrame, shard_count: int) -> DataFrame:
    """Give every empty shard the vector that is farthest from its own center, ties to the smaller id. Donors keep at least one member.

    Only as many candidates as there are empty shards come to the driver."""
    used = {r[0]: r[1] for r in shard_counts(assigned).collect()}
    empty = [s for s in range(shard_count) if s not in used]
    if not empty:
        return assigned
    # all but the nearest member of each shard may go; a maximum a shard and a top-k, so no shard is sorted
    last = assigned.groupBy("shard_id").agg(F.max(F.struct("similarity", "id")).alias("last"))
    spare = assigned.join(last, "shard_id").where(F.struct("similarity", "id") != F.col("last"))
    moved = [r["id"] for r in spare.orderBy("similarity", "id").limit(len(empty)).select("id").collect()]
    if len(moved) < len(empty):
        raise ValueError("there are fewer vectors than shards")
    kind = assigned.schema["id"].dataType.simpleString()
    moves = assigned.sparkSession.createDataFrame(list(zip(moved, empty, strict=True)), f"id {kind}, moved_to int")
    return assigned.join(moves, "id", "left").withColumn("shard_id", F.coalesce("moved_to", "shard_id")).drop("moved_to")


def kmeans_shards(rows: DataFrame, shard_count: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """rows (id, vector) with shard_id 0 .. shard_count - 1, all of them used, by cosine k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if rows.limit(shard_count).count() < shard_count:
        raise ValueError("there are fewer vectors than shards")
    model = KMeans(k=shard_count, seed=seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="features").fit(rows.select(array_to_vector("vector").alias("features")))
    centers = np.array([c / max(np.linalg.norm(c), 1e-300) for c in model.clusterCenters()])
    return repair_empty(assign(rows, centers), shard_count).drop("similarity")
