"""Calibration of the number of probed shards, and summaries of latencies."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot
from tessera.operators.search import DECIMALS, block_topk


@dataclass(frozen=True)
class Calibration:
    probe_shards: int
    target: float
    mean_recall: dict[int, float]
    least_recall: dict[int, float]


def recall_by_probe(rows: DataFrame, queries: DataFrame, centers: DataFrame, k: int, probes: Iterable[int]) -> DataFrame:
    """(probe, mean_recall, least_recall). A true neighbour is found with P probed shards exactly if its shard is among the first P of the query's
    ranking: the k best of all rows are also the best of any set of shards that holds them. So one exact search and one ranking serve all P."""
    scores = queries.select("query_id", "vector").crossJoin(centers.select("shard_id", "centroid"))
    scores = scores.withColumn("score", F.round(dot(F.col("vector"), F.col("centroid")), DECIMALS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "shard_id")
    ranked = scores.select("query_id", "shard_id", F.row_number().over(order).alias("place"))
    true = block_topk(rows, queries, k).join(rows.select("id", "shard_id"), "id").join(ranked, ["query_id", "shard_id"])
    probe = F.explode(F.array(*[F.lit(p) for p in sorted(set(probes))])).alias("probe")
    hits = true.select("query_id", "place", probe).groupBy("query_id", "probe").agg((F.count_if(F.col("place") <= F.col("probe")) / F.count("*")).alias("recall"))
    return hits.groupBy("probe").agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("least_recall"))


def calibrate(rows: DataFrame, queries: DataFrame, centers: DataFrame, k: int, probes: Iterable[int], target: float = 0.95) -> Calibration:
    """The least number of probed shards with the target recall, or the largest tried."""
    if not 0 < target <= 1:
        raise ValueError("the target must be in (0, 1]")
    most = centers.count()
    probes = sorted({int(p) for p in probes if 1 <= int(p) <= most})
    if not probes:
        raise ValueError("no number of probed shards is valid")
    found = {r["probe"]: r for r in recall_by_probe(rows, queries, centers, k, probes).collect()}
    mean = {p: found[p]["mean_recall"] for p in probes}
    return Calibration(next((p for p in probes if mean[p] >= target), probes[-1]), target, mean, {p: found[p]["least_recall"] for p in probes})


def latency_summary(df: DataFrame, value: Column, *groups: str) -> DataFrame:
    """count, mean and the 50th, 95th and 99th percentile, interpolated linearly."""
    cuts = [F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)]
    return df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *cuts)
