"""Connected components of a graph given as edges, in DataFrame operations (alternating large-star and small-star).

Each round points every node's larger neighbours, and then its smaller ones, at the smallest node it knows. The number of edges never
grows, rounds grow with the logarithm of the number of nodes, and only minima are taken per node, so a hub with very
many neighbours is aggregated before the shuffle and its rows are split by adaptive execution in the joins. Nothing comes to the
driver but two numbers a round. Each round is written to the shared folder, and so are the minima before they are joined: as a table of their own
they leave the join two plain exchanges, which is what adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b), two columns of longs; component is the smallest node reachable."""
    a, b = edges.columns
    current = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components"
    )
    state = _state(current)
    while True:
        # an edge (u, v) with u > v hangs u under the least neighbour of v; only what stands first in an edge has a smaller one
        parents = materialise(current.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"), "parents")
        hung = current.join(parents, F.col("v") == F.col("node"), "left")
        large = hung.select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = materialise(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "components")
        discard(current)
        discard(parents)
        current, before, state = after, state, _state(after)
        if state == before:
            break
    roots = current.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return current.unionByName(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))
