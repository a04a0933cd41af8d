"""Mixing sources to target weights.

Tokens are summed per source, a source's target gives its repetition rate, and each document goes out floor(rate) times plus
once more with a chance of the remaining fraction, decided by a hash of the seed, its id and its text, so rows with one id, or none, are decided
each for itself. All of it is DataFrame code.

Targets: the mix has `share` times all words. Sources, ordered by code point with null last, weigh `weights` in turn; none gets
more than `most` times its own words, and what that leaves over goes to the others by weight. With sources ordered by
cap / weight, source i is at its cap if the level (T - caps before it) / (weights from it on) is at least its cap / weight; the
level of the first source that is not holds for it and all after it. So no iteration is needed.

Shape of the plan: one partial aggregation by source, a window over the sources (one row each, not over the documents), and a
join of the documents with that table. The table is written first, so Spark knows its size and broadcasts it only when it is below
the session's threshold; above it the join sorts, and a popular source's rows are split by adaptive execution.

Defined results: a null text has size 0; null sources form one source; an empty table gives an empty result; rows equal in doc_id and
text take the same decision; other columns are ignored by mix_plan and kept by mixed_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and keys: the same on every engine and run."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size)."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    target = F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap"))
    ranked = by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), "place")
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        capped.withColumn("total", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("caps_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.sum("weight").over(from_here))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    )
    first_open = F.min(F.when(F.col("open"), F.struct("caps_before", "place", "level"))).over(everything)
    # caps_before never falls along the order, so the smallest belongs to the first open source
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return levels.withColumn("final", first_open["level"]).select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _with_copies(docs: DataFrame, weights, share, most, seed) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies; docs' own columns stay as they are."""
    sized = docs.select("source", size_of(F.col("text")).alias("size"))
    targets = materialise(source_targets(sized, weights, share, most), "mix-targets").select(
        F.col("source").alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate")
    )
    joined = docs.withColumn("mix_size", size_of(docs["text"])).join(targets, docs["source"].eqNullSafe(targets["mix_key"]))
    whole = F.floor("mix_rate")
    extra = (unit_interval(seed, F.col("doc_id"), F.md5(F.col("text").cast("binary"))) < F.col("mix_rate") - whole).cast("long")
    return joined.withColumn("mix_copies", whole + extra).drop("mix_key", "mix_rate")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words times its copies) and copies."""
    planned = _with_copies(docs.select("doc_id", "text", "source"), weights, share, most, seed)
    return planned.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"),
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as its plan says, with the columns of docs."""
    planned = _with_copies(docs, weights, share, most, seed).where("mix_copies > 0")
    repeated = planned.withColumn("mix_copy", F.explode(F.expr("sequence(1, cast(mix_copies as int))")))
    return repeated.select(*docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(md5(text), 'null') AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM by_source
), capped AS (
  SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM ranked
), summed AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total,
    sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS caps_before,
    sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM capped
), levels AS (
  SELECT *, (total - caps_before) / weights_left AS level FROM summed
), final AS (
  SELECT arg_min(level, caps_before) AS level FROM levels WHERE level * weight < cap
), targets AS (
  SELECT source, source_size, coalesce(least(cap, f.level * weight), cap) AS target
  FROM levels CROSS JOIN (SELECT max(level) AS level FROM final) f
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate FROM targets
), planned AS (
  SELECT doc_id, size, source_size, target, CAST(floor(rate) AS BIGINT)
    + CASE WHEN CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0
           < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM planned
"""
