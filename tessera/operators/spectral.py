"""Fourier transform along the shard axis, in two forms with one meaning.

The table form keeps everything as rows and built-in functions, for any engine to check; the NumPy form serves routing. Centroids in
an order n = 0 .. S-1 have the coefficients F_k = sum_n c_n exp(-2 pi i k n / S). Band b keeps k = 0 .. b of the half spectrum, with
weight 1 for k = 0 and, for even S, k = S/2, and 2 otherwise (the other half is its conjugate).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_band(shards: int) -> int:
    return shards // 2


def clean_bands(bands, shards: int) -> tuple[int, ...]:
    """Bands in 0 .. S/2, ascending, each once; larger ones become the full band."""
    found = sorted({min(max(int(b), 0), full_band(shards)) for b in bands})
    if not found:
        raise ValueError("at least one band is needed")
    return tuple(found)


def band_frequencies(shards: int, band: int) -> list[int]:
    """Frequencies of the whole spectrum that a band keeps, the conjugate ones included."""
    band = min(max(band, 0), full_band(shards))
    return sorted({k % shards for k in range(-band, band + 1)})


def _angle(k: Column, n: Column, shards: int) -> Column:
    return F.lit(2 * math.pi) * k * n / F.lit(float(shards))


def _weight(k: Column, shards: int) -> Column:
    lone = (k == 0) if shards % 2 else (k == 0) | (k == shards // 2)
    return F.when(lone, 1.0).otherwise(2.0)


def long_form(centers: DataFrame) -> DataFrame:
    """(n, i, v) from (n, centroid)."""
    return centers.select("n", F.posexplode("centroid").alias("i", "v"))


def spectrum(long: DataFrame, shards: int) -> DataFrame:
    """(k, i, re, im), k = 0 .. S/2."""
    k = F.explode(F.sequence(F.lit(0), F.lit(full_band(shards)))).alias("k")
    each = long.select(k, "n", "i", "v")
    a = _angle(F.col("k"), F.col("n"), shards)
    return each.groupBy("k", "i").agg(F.sum(F.col("v") * F.cos(a)).alias("re"), (-F.sum(F.col("v") * F.sin(a))).alias("im"))


def reconstruct(spec: DataFrame, shards: int, bands) -> DataFrame:
    """(band, n, i, value): the centroids that each band keeps."""
    kept = spec.select(F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"), "k", "i", "re", "im").where("k <= band")
    each = kept.select("band", "k", "i", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("n"))
    a = _angle(F.col("k"), F.col("n"), shards)
    part = _weight(F.col("k"), shards) * (F.col("re") * F.cos(a) - F.col("im") * F.sin(a)) / F.lit(float(shards))
    return each.groupBy("band", "n", "i").agg(F.sum(part).alias("value"))


def residuals(long: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(band, n, residual): distance between a centroid and what its band keeps."""
    gap = rebuilt.join(long, ["n", "i"]).groupBy("band", "n").agg(F.sum((F.col("v") - F.col("value")) * (F.col("v") - F.col("value"))).alias("s"))
    return gap.select("band", "n", F.sqrt("s").alias("residual"))


def approximate_scores(rebuilt: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, band, n, score) for queries (query_id, i, q)."""
    return rebuilt.join(queries, "i").groupBy("query_id", "band", "n").agg(F.sum(F.col("value") * F.col("q")).alias("score"))


def energy(spec: DataFrame, shards: int, bands) -> DataFrame:
    """(band, energy): share of the squared spectrum that a band keeps."""
    power = spec.select("k", (_weight(F.col("k"), shards) * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("p"))
    part = [F.sum(F.when(F.col("k") <= b, F.col("p")).otherwise(0.0)) / F.sum("p") for b in bands]
    return power.agg(F.array(*[F.struct(F.lit(b).alias("band"), e.alias("energy")) for b, e in zip(bands, part, strict=True)]).alias("x")).select(F.inline("x"))


def intervals(scores: DataFrame, gaps: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """scores with lower and upper bounds of the exact score: score -+ |q| residual. norms: (query_id, norm), 1 if not given."""
    joined = scores.join(gaps, ["band", "n"])
    width = F.col("residual")
    if norms is not None:
        joined, width = joined.join(norms, "query_id"), F.col("residual") * F.col("norm")
    return joined.select("query_id", "band", "n", "score", (F.col("score") - width).alias("lower"), (F.col("score") + width).alias("upper"))


def certify(bounds: DataFrame, count: int, slack: float = 1e-9) -> DataFrame:
    """(query_id, band, shards, margin, certified): the `count` best by score, and whether no other shard can be better.

    The margin is the least lower bound chosen minus the greatest upper bound left; null if none is left, which certifies."""
    order = Window.partitionBy("query_id", "band").orderBy(F.desc(F.round("score", 9)), "n")
    ranked = bounds.withColumn("place", F.row_number().over(order))
    chosen = F.col("place") <= count
    summed = ranked.groupBy("query_id", "band").agg(
        F.array_sort(F.collect_list(F.when(chosen, F.col("n")))).alias("shards"),
        (F.min(F.when(chosen, F.col("lower"))) - F.max(F.when(~chosen, F.col("upper")))).alias("margin"),
    )
    return summed.withColumn("certified", F.coalesce(F.col("margin") >= slack, F.lit(True)))


def coverage(bounds: DataFrame, exact: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(band, covered): whether every exact score (query_id, n, exact) lies in its interval."""
    inside = (F.col("lower") <= F.col("exact") + tolerance) & (F.col("exact") <= F.col("upper") + tolerance)
    return bounds.join(exact, ["query_id", "n"]).groupBy("band").agg(F.bool_and(inside).alias("covered"))


# NumPy form --------------------------------------------------------------------------------------------------------------


def half_spectrum(ordered: np.ndarray, band: int | None = None) -> np.ndarray:
    spec = np.fft.rfft(ordered, axis=0)
    return spec if band is None else spec[: min(band, full_band(len(ordered))) + 1]


def rebuild(spec: np.ndarray, shards: int, band: int) -> np.ndarray:
    """Centroids from the frequencies up to band."""
    kept = np.zeros((full_band(shards) + 1, *spec.shape[1:]), complex)
    kept[: band + 1] = spec[: band + 1]
    return np.fft.irfft(kept, n=shards, axis=0)


def residual_norms(ordered: np.ndarray, band: int) -> np.ndarray:
    return np.linalg.norm(ordered - rebuild(half_spectrum(ordered), len(ordered), band), axis=1)


def energy_fraction(ordered: np.ndarray, band: int) -> float:
    spec, shards = half_spectrum(ordered), len(ordered)
    weight = np.full(len(spec), 2.0)
    weight[0] = 1
    if shards % 2 == 0:
        weight[-1] = 1
    power = weight[:, None] * np.abs(spec) ** 2
    total = power.sum()
    return float(power[: band + 1].sum() / total) if total else 1.0


def moved_spectrum(spec: np.ndarray, place: int, change: np.ndarray, shards: int) -> np.ndarray:
    """The half spectrum after the centroid at a place changed: F'_k = F_k + change * exp(-2 pi i k place / S)."""
    k = np.arange(len(spec))
    return spec + np.exp(-2j * np.pi * k * place / shards)[:, None] * change[None, :]
