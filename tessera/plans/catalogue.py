"""Registered queries: every operator on the driver's tables, with its SQL where SQL can express it.

The vectors are `embeddings`, their shard is `label` (ten shards, numbered like the labels), and the queries are the vectors whose vec_id is divisible by 20: a stated
set of queries that is searched in whole tables. Products are `part` with the vector of the same number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.vectors import distance, dot
from tessera.operators import baselines, bounds, evaluation, local_index, ordering, search, shards, spectral
from tessera.operators.router import Router, RouterConfig
from tessera.plans import capacity
from tessera.plans.catalog import Filters, page
from tessera.sources import catalog_csv, generator

PROBE, TOP = 3, 10
BANDS = (1, 2, 5)
FILTERS = Filters(price_min=905, price_max=990, in_stock_only=True)
PROBES = (1, 2, 3, 5, 10)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.valid_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label").alias("shard_id"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vector) of every 20th id."""
    return _rows(spark, sf_dir).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price_ron"), (F.col("p_size") % 13 != 0).alias("in_stock")
    )
    return _rows(spark, sf_dir).join(part, "id")


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.centroids(_rows(spark, sf_dir))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, centroid) in the order of the labels."""
    return _centers(spark, sf_dir).select(F.col("shard_id").alias("n"), "centroid")


def _shard_count(ordered: DataFrame) -> int:
    return ordered.count()


def _pairs(queries: DataFrame, centers: DataFrame) -> DataFrame:
    """Queries by centroids with their score: the number of shards is a setting, not data."""
    return queries.crossJoin(centers).withColumn("score", F.round(dot(F.col("vector"), F.col("centroid")), 6) + F.lit(0.0))


def _routes(spark: SparkSession, sf_dir: str) -> dict[int, list[int]]:
    numbers, centers = shards.matrix(_centers(spark, sf_dir), "shard_id", "centroid")
    ids, asked = shards.matrix(_queries(spark, sf_dir), "query_id", "vector")
    places = np.argsort(-np.round(asked @ centers.T, 6), axis=1, kind="stable")[:, :PROBE]
    return {q: [numbers[i] for i in line] for q, line in zip(ids, places, strict=True)}


# Search ------------------------------------------------------------------------------------------------------------------


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.block_topk(_rows(spark, sf_dir), _queries(spark, sf_dir), TOP)


def euclidean_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = raw.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")
    return search.block_topk(raw, queries, TOP, "euclidean")


def exact_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _pairs(_queries(spark, sf_dir), _centers(spark, sf_dir)).select("query_id", F.col("shard_id").alias("id"), "score")
    return search.top(scored, PROBE).withColumnRenamed("id", "shard_id")


def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_index.lsh_topk(_rows(spark, sf_dir), _queries(spark, sf_dir), TOP)


def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the approximate local search against the exact one, and the rows it met."""
    rows, queries = _rows(spark, sf_dir), _queries(spark, sf_dir)
    measured = search.recall_precision(local_index.lsh_topk(rows, queries, TOP), search.block_topk(rows, queries, TOP), TOP)
    met = local_index.lsh_candidates(rows, queries).select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("rows_met"))
    return measured.join(met, "query_id", "left").select("query_id", F.round("recall", 6).alias("recall"), F.coalesce("rows_met", F.lit(0)).alias("rows_met"))


def routed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.block_topk(_rows(spark, sf_dir), _queries(spark, sf_dir), TOP, routes=_routes(spark, sf_dir))


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = shards.shard_counts(_rows(spark, sf_dir))
    return exact_route(spark, sf_dir).join(counts, "shard_id").groupBy("query_id").agg(F.sum("item_count").alias("candidates"), F.count("*").alias("shards"))


def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.recall_precision(routed_topk(spark, sf_dir), exact_topk(spark, sf_dir), TOP)
    return found.select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def calibration_by_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.recall_by_probe(_rows(spark, sf_dir), _queries(spark, sf_dir), _centers(spark, sf_dir), TOP, PROBES)
    return found.select("probe", F.round("mean_recall", 6).alias("mean_recall"), F.round("least_recall", 6).alias("least_recall"))


def filtered_topk_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.block_topk(_products(spark, sf_dir).where(FILTERS.condition()), _queries(spark, sf_dir), TOP)


def filtered_topk_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, queries, routes = _products(spark, sf_dir), _queries(spark, sf_dir), _routes(spark, sf_dir)
    found = search.block_topk(products.where(FILTERS.condition()), queries, TOP, routes=routes)
    at = search.places(products, search.kth_results(found, queries, TOP), routes)
    return found.join(at.select("query_id", search.budget_rounds(F.col("place"), F.col("capacity"), TOP).alias("budget_rounds")), "query_id")


def _of_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).where(Filters(brand="BRAND#11").condition())


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.all_ranked(_of_brand(spark, sf_dir), _queries(spark, sf_dir))


def page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page needs the ranks up to its last one, not a ranking of everything."""
    return page(search.block_topk(_of_brand(spark, sf_dir), _queries(spark, sf_dir), 2 * 5), 2, 5)


def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _products(spark, sf_dir).drop("vector", "shard_id")
    return exact_topk(spark, sf_dir).join(products, "id").select("query_id", "rank", "id", "title", "brand", "category", "price_ron", "in_stock")


# Vectors and shards ------------------------------------------------------------------------------------------------------


def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", F.posexplode("vector").alias("i", "x")).select("id", "i", F.round("x", 6).alias("value"))


def shard_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _centers(spark, sf_dir).select("shard_id", "item_count", F.posexplode("centroid").alias("i", "x"))
    return each.select("shard_id", "item_count", "i", F.round("x", 6).alias("value"))


def shard_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return shards.radii(rows, shards.centroids(rows)).select("shard_id", F.round("euclidean_radius", 6).alias("euclidean_radius"), F.round("angular_radius", 6).alias("angular_radius"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_counts(_rows(spark, sf_dir))


def shard_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = shards.shard_table(_rows(spark, sf_dir))
    return table.select("shard_id", "item_count", F.round("euclidean_radius", 6).alias("euclidean_radius"), F.round("angular_radius", 6).alias("angular_radius"), "path")


def kmeans_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kmeans_shards(_rows(spark, sf_dir).select("id", "vector"), 16).select("id", "shard_id")


def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest center, the step that all clustering here repeats; the centers are those of the labels."""
    numbers, centers = shards.matrix(_centers(spark, sf_dir), "shard_id", "centroid")
    found = shards.assign(_rows(spark, sf_dir).select("id", "vector"), centers)
    label = F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("shard_id") + 1)
    return found.select("id", label.alias("shard_id"), (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"))


# Spectrum, certificates, routing -------------------------------------------------------------------------------------------


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _ordered(spark, sf_dir)
    found = spectral.spectrum(spectral.long_form(ordered), _shard_count(ordered))
    return found.select("k", "i", (F.round("re", 6) + F.lit(0.0)).alias("re"), (F.round("im", 6) + F.lit(0.0)).alias("im"))


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    ordered = _ordered(spark, sf_dir)
    n, long = _shard_count(ordered), spectral.long_form(ordered)
    return long, spectral.reconstruct(spectral.spectrum(long, n), n, spectral.clean_bands(BANDS, n)), n


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, rebuilt, _ = _rebuilt(spark, sf_dir)
    return spectral.residuals(long, rebuilt).select("band", "n", F.round("residual", 6).alias("residual"))


def _long_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select("query_id", F.posexplode("vector").alias("i", "q"))


def spectral_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rebuilt, _ = _rebuilt(spark, sf_dir)
    found = spectral.approximate_scores(rebuilt, _long_queries(spark, sf_dir))
    return found.select("query_id", "band", "n", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, rebuilt, _ = _rebuilt(spark, sf_dir)
    return spectral.intervals(spectral.approximate_scores(rebuilt, _long_queries(spark, sf_dir)), spectral.residuals(long, rebuilt))


def score_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _intervals(spark, sf_dir)
    return found.select("query_id", "band", "n", (F.round("lower", 6) + F.lit(0.0)).alias("lower"), (F.round("upper", 6) + F.lit(0.0)).alias("upper"))


def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = _queries(spark, sf_dir).crossJoin(_ordered(spark, sf_dir)).select("query_id", "n", dot(F.col("vector"), F.col("centroid")).alias("exact"))
    return spectral.coverage(_intervals(spark, sf_dir), exact, 1e-9)


def certify_topb(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.certify(_intervals(spark, sf_dir), PROBE)
    return found.select("query_id", "band", F.array_join("shards", ",").alias("shards"), (F.round("margin", 6) + F.lit(0.0)).alias("margin"), "certified")


def curve_fixture(spark: SparkSession, noise: float = 0.02) -> tuple[np.ndarray, DataFrame]:
    """64 centroids on a smooth curve with a little of frequency 9, and 40 queries between them: most of these routes can be certified."""
    t = 2 * np.pi * np.arange(64) / 64
    curve = lambda x, e: np.stack([np.cos(x), np.sin(x), 0.5 * np.cos(2 * x), 0.5 * np.sin(2 * x), e * np.cos(9 * x), e * np.sin(9 * x)], axis=1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    asked = unit(curve(2 * np.pi * (1.6 * np.arange(40) + 0.3) / 64, 0.0))
    return unit(curve(t, noise)), spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(asked)], "query_id long, vector array<double>")


def adaptive_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers, asked = curve_fixture(spark)
    router = Router.fit(centers, RouterConfig(shards=64, bands=(1, 2, 4, 16), probe_shards=8, ordering="identity"))
    found = router.route_table(asked)
    return found.select("query_id", "used_band", "certified", "fallback", "route_mode", F.array_join(F.array_sort("shard_ids"), ",").alias("shards"))


def adaptive_route_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive routing of the vectors' own queries among their shards."""
    _, centers = shards.matrix(_centers(spark, sf_dir), "shard_id", "centroid")
    router = Router.fit(centers, RouterConfig(shards=len(centers), bands=(1, 2), probe_shards=PROBE, ordering="identity"))
    found = router.route_table(_queries(spark, sf_dir))
    return found.select("query_id", "used_band", "certified", "fallback", "route_mode", F.array_join(F.array_sort("shard_ids"), ",").alias("shards"))


def route_mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centers = shards.matrix(_centers(spark, sf_dir), "shard_id", "centroid")
    router = Router.fit(centers, RouterConfig(shards=len(centers), bands=(1, 2), probe_shards=PROBE, ordering="identity"))
    return router.route_table(_queries(spark, sf_dir)).groupBy("route_mode").agg(F.count("*").alias("queries"))


def spectral_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _ordered(spark, sf_dir)
    n = _shard_count(ordered)
    found = spectral.energy(spectral.spectrum(spectral.long_form(ordered), n), n, spectral.clean_bands((0, *BANDS), n))
    return found.select("band", F.round("energy", 6).alias("energy"))


def ordering_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordering.ordering_quality(_ordered(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def incremental_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum after shard 0 took the centroid of the last shard, by changing the old one."""
    numbers, centers = shards.matrix(_centers(spark, sf_dir), "shard_id", "centroid")
    router = Router.fit(centers, RouterConfig(shards=len(numbers), bands=(5,), probe_shards=1, ordering="identity"))
    moved = router.updated(0, centers[-1], incremental=True).spectrum
    rows = [(k, i, round(float(z.real), 6) + 0.0, round(float(z.imag), 6) + 0.0) for k, line in enumerate(moved) for i, z in enumerate(line)]
    return spark.createDataFrame(rows, "k int, i int, re double, im double")


def _after(spark: SparkSession, router: Router) -> DataFrame:
    return spark.createDataFrame([(n, i, round(float(x), 6) + 0.0) for n, line in enumerate(router.centroids) for i, x in enumerate(line)], "n int, i int, value double")


def _label_router(spark: SparkSession, sf_dir: str) -> Router:
    _, centers = shards.matrix(_centers(spark, sf_dir), "shard_id", "centroid")
    return Router.fit(centers, RouterConfig(shards=len(centers), bands=(5,), probe_shards=1, ordering="identity"))


def remove_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, _label_router(spark, sf_dir).removed(3))


def merge_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    router = _label_router(spark, sf_dir)
    return _after(spark, router.merged(2, 5, (router.centroids[2] + router.centroids[5]) / 2))


def add_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    router = _label_router(spark, sf_dir)
    return _after(spark, router.added(router.centroids[0] + router.centroids[1]))


def split_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    router = _label_router(spark, sf_dir)
    c = router.centroids
    return _after(spark, router.split(4, c[4] + c[0], c[4] + c[1]))


# Bounds ------------------------------------------------------------------------------------------------------------------


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, shard_id, score, distance, radius, angle) of every query and shard."""
    rows = _rows(spark, sf_dir)
    centers = shards.centroids(rows)
    table = centers.join(shards.radii(rows, centers), "shard_id")
    return _queries(spark, sf_dir).crossJoin(table).select(
        "query_id", "shard_id", dot(F.col("vector"), F.col("centroid")).alias("score"), distance(F.col("vector"), F.col("centroid")).alias("distance"), "euclidean_radius", "angular_radius"
    )


def _two(df: DataFrame, low, high) -> DataFrame:
    return df.select("query_id", "shard_id", (F.round(low, 6) + F.lit(0.0)).alias("lower"), (F.round(high, 6) + F.lit(0.0)).alias("upper"))


def ball_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(_measured(spark, sf_dir), *bounds.ball_bounds(F.col("score"), F.col("score"), F.col("euclidean_radius")))


def angular_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(_measured(spark, sf_dir), *bounds.angular_bounds(F.col("score"), F.col("angular_radius")))


def min_distance_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bounds.min_distance(F.col("distance"), F.col("euclidean_radius"))
    return _measured(spark, sf_dir).select("query_id", "shard_id", (F.round(found, 6) + F.lit(0.0)).alias("min_distance"))


def pruning_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = exact_route(spark, sf_dir).select("query_id", "shard_id", F.lit(True).alias("hit"))
    upper = bounds.ball_bounds(F.col("score"), F.col("score"), F.col("euclidean_radius"))[1]
    limits = _measured(spark, sf_dir).join(routed, ["query_id", "shard_id"], "left").select("query_id", "shard_id", F.coalesce("hit", F.lit(False)).alias("routed"), upper.alias("upper"))
    kth = routed_topk(spark, sf_dir).where(F.col("rank") == TOP).select("query_id", F.col("score").alias("kth_score"))
    found = bounds.pruning_certificate(limits, kth)
    return found.select("query_id", "skipped", F.round("best_skipped", 6).alias("best_skipped"), "certified")


# Catalog import, text ------------------------------------------------------------------------------------------------------


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as a catalog file would give it, with faults by part key: blank and repeated ids, blank titles, bad prices and stock words."""
    key = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    price = F.concat_ws(".", F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0"))
    part = _table(spark, sf_dir, "part")
    return part.select(
        (key + 2).alias("line_number"),
        F.when(key % 29 == 0, "  ").otherwise(F.concat(F.lit("P"), F.when((key % 11 == 0) & (key > 0), key - 1).otherwise(key).cast("string"))).alias("product_id"),
        F.when(key % 31 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("title"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        F.when(key % 7 == 0, " ").otherwise(F.col("p_type")).alias("category"), F.col("p_brand").alias("brand"),
        F.when(key % 13 == 0, "abc").when(key % 17 == 0, "-5").when(key % 19 == 0, F.replace(price, F.lit("."), F.lit(","))).when(key % 23 == 0, "nan").when(key % 37 == 0, "").otherwise(price).alias("price_ron"),
        F.lit(None).cast("string").alias("color"), F.when(key % 2 == 0, "unisex").alias("audience"),
        F.when(key % 41 == 0, "maybe").when(key % 5 == 0, "da").when(key % 5 == 1, "").when(key % 5 == 2, "No").when(key % 5 == 3, " TRUE ").otherwise("nu").alias("in_stock"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_csv.judged(catalog_csv.numbered(raw_catalog(spark, sf_dir)))


def import_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_csv.valid_products(_judged(spark, sf_dir))


def import_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_csv.rejects(_judged(spark, sf_dir))


def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_csv.report(_judged(spark, sf_dir))


def semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_valid(spark, sf_dir).select("product_id", catalog_csv.semantic_text().alias("semantic_text"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def _feature_counts(texts: DataFrame) -> DataFrame:
    """Words and pairs are counted first, and only the different words are cut into n-grams, which take the word's count."""
    words = texts.select(text.tokens(F.col("text")).alias("t"))
    each = words.select(F.explode(F.concat(F.transform("t", lambda w: F.concat(F.lit("w:"), w)), text.neighbours(F.col("t")))).alias("feature"))
    counts = each.groupBy("feature").agg(F.count("*").alias("n"))
    pair = F.array(F.struct("feature", F.lit(text.PAIR_WEIGHT).alias("weight")))
    cut = F.when(F.col("feature").startswith("w:"), text.ngram_features(F.array(F.substring("feature", 3, 2**31 - 1)))).otherwise(pair)
    features = counts.select(F.explode(cut).alias("f"), "n")
    return features.groupBy(F.col("f.feature").alias("feature")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("f.weight")), 6).alias("weight"))


def ngram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_counts(_table(spark, sf_dir, "benchmark"))


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of the whole corpus, folded as for the embedding."""
    return _feature_counts(_table(spark, sf_dir, "documents").select(text.fold_column(F.col("text")).alias("text")))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.embed(_table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", text.HashProvider(64)).select("item_id", "embedding")


def document_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.embed(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", text.HashProvider(64)).select("doc_id", "embedding")


# Baselines, models, generator --------------------------------------------------------------------------------------------------


def _routed_by(spark: SparkSession, sf_dir: str, route: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    _, centers = shards.matrix(_centers(spark, sf_dir), "shard_id", "centroid")
    ids, asked = shards.matrix(_queries(spark, sf_dir), "query_id", "vector")
    return spark.createDataFrame([(q, int(r) + 1, int(s)) for q, line in zip(ids, route(centers, asked), strict=True) for r, s in enumerate(line)], "query_id long, rank int, shard_id int")


def lowrank_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed_by(spark, sf_dir, lambda c, q: baselines.LowRank(c, 4).route(q, PROBE))


def hierarchical_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed_by(spark, sf_dir, lambda c, q: baselines.Hierarchical(c).route(q, PROBE))


def random_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed_by(spark, sf_dir, lambda c, q: baselines.random_shards(len(c), len(q), PROBE))


def capacity_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.estimate_table(spark, {"router_ms": 2.971, "local_p95_ms": 8.0, "network_p95_ms": 1.5, "merge_ms": 0.5}).select(
        "items", "shards", "band", "items_per_shard", "routed_items", "reduction", "exact_multiply_adds", "spectral_terms", "inverse_operations", "centroid_bytes_32", "spectral_bytes_64", "residual_bytes_32", F.round("total_ms", 6).alias("total_ms"), "physical"
    )


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.latency_summary(_table(spark, sf_dir, "events"), F.col("value"), "event_type")
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.products(spark, _table(spark, sf_dir, "part").count())


def synthetic_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir)


def category_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir).groupBy("category").agg(F.count("*").alias("products"), F.count_if("in_stock").alias("in_stock"), F.min("price_ron").alias("cheapest"), F.max("price_ron").alias("dearest"))


def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.constraint_checks(_generated(spark, sf_dir), generator.categories(spark))


def streaming_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard sizes from a stream of the embeddings' files, run until all of them are read."""
    import uuid

    static = _table(spark, sf_dir, "embeddings")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/embeddings.parquet*")
    name = f"shard_counts_{uuid.uuid4().hex}"
    counts = stream.groupBy(F.col("label").alias("shard_id")).agg(F.count("*").alias("item_count"))
    running = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


_REGISTERED = (
    exact_topk, euclidean_topk, lsh_topk, lsh_recall, exact_route, routed_topk, candidate_counts, recall_precision, calibration_by_probe, filtered_topk_pre, filtered_topk_post, all_results, page_2, product_lookup,
    normalize_rows, shard_centroids, shard_radii, shard_counts, shard_metadata, kmeans_shards, nearest_center, spectrum, residuals, spectral_scores, score_intervals, interval_coverage, certify_topb, adaptive_route,
    adaptive_route_vectors, route_mode_counts, spectral_energy, ordering_quality, incremental_spectrum, remove_shard, merge_shard, add_shard, split_shard, ball_bounds, angular_bounds, min_distance_bounds, pruning_certificate,
    import_valid, import_rejects, import_report, semantic_text, tokens, ngram_features, document_features, hash_embedding, document_embedding, lowrank_route, hierarchical_route, random_route, capacity_estimate, latency_summary,
    synthetic_catalog, category_balance, constraint_checks, streaming_shard_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _REGISTERED}


def oracle_sql() -> dict[str, str]:
    from tessera.plans import oracle

    return oracle.statements()
