"""What can be said of a shard's vectors from its centroid and radius, as columns.

All bounds are sound for any query length: the query's norm is an argument, and scores are only clipped to [-1, 1] for unit queries and vectors.
A null radius (a shard that changed and was not measured again) gives null bounds, and a null bound never certifies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import clip


def ball_bounds(lower: Column, upper: Column, radius: Column, query_norm: Column | float = 1.0, unit: bool = True) -> tuple[Column, Column]:
    """Scores of all vectors within radius of a centroid whose own score lies in [lower, upper]."""
    reach = (F.lit(query_norm) if isinstance(query_norm, (int, float)) else query_norm) * radius
    low, high = lower - reach, upper + reach
    return (clip(low, -1.0, 1.0), clip(high, -1.0, 1.0)) if unit else (low, high)


def angular_bounds(score: Column, angle: Column) -> tuple[Column, Column]:
    """The same for unit vectors within an angle of a unit centroid; tighter than the ball."""
    centre = F.acos(clip(score, -1.0, 1.0))
    pi = 3.141592653589793
    return F.cos(clip(centre + angle, 0.0, pi)), F.cos(clip(centre - angle, 0.0, pi))


def min_distance(distance: Column, radius: Column) -> Column:
    """The least distance that a vector within radius of a centroid at this distance can have."""
    return F.greatest(F.lit(0.0), distance - radius)


def pruning_certificate(shard_bounds: DataFrame, kth: DataFrame) -> DataFrame:
    """(query_id, skipped, best_skipped, certified): whether no vector of a skipped shard can beat the k-th result.

    shard_bounds: (query_id, shard_id, routed, upper) for all shards; kth: (query_id, kth_score), null where fewer than k were found. With no shard
    skipped the answer is certified; with a missing bound or score it is not."""
    skipped = ~F.col("routed")
    summed = shard_bounds.groupBy("query_id").agg(
        F.count_if(skipped).alias("skipped"), F.max(F.when(skipped, F.col("upper"))).alias("best_skipped"), F.count_if(skipped & F.col("upper").isNull()).alias("unknown")
    )
    sure = (F.col("skipped") == 0) | ((F.col("unknown") == 0) & F.coalesce(F.col("best_skipped") <= F.col("kth_score"), F.lit(False)))
    return summed.join(kth, "query_id", "left").select("query_id", "skipped", "best_skipped", sure.alias("certified"))
