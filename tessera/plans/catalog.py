"""A searchable catalog: built from a CSV file or a product table, stored as Parquet, searched in batches.

Layout of a catalog directory: products/, rejects/, semantic_texts/ (JSON lines), embeddings/ (kept for the next build of the same source),
vectors/ (partitioned by shard_id), local_index/ (keys of an approximate local index, if one is used), shards/ (a row per shard), router.json (order, bands, checksum), import_report.json, catalog_manifest.json.
Vectors lie in their shard's partition, so a routed search reads only the shards that its queries were sent to.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from time import perf_counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import EmbeddingProvider, create_provider, embed
from tessera.operators import search, shards
from tessera.operators.local_index import check_consistency, checked_backend, chosen_backend, lsh_topk, stored_topk, write_index
from tessera.operators.router import Router, RouterConfig
from tessera.sources import catalog_csv, files

VERSION = 1
#: The columns of the evaluation log, in order.
EVALUATION_FIELDS = (
    "query", "selected_shards", "used_band", "route_mode", "certified", "vector_pruning_certified", "fallback", "routing_latency_ms", "local_search_latency_ms", "total_latency_ms", "result_product_ids", "oracle_product_ids",
    "recall_at_k", "precision_at_k", "filter_strategy",
)


@dataclass(frozen=True)
class Filters:
    """All conditions must hold; bounds are inclusive, texts are compared without case, and a missing value fails."""

    price_min: float | None = None
    price_max: float | None = None
    category: str | None = None
    brand: str | None = None
    color: str | None = None
    audience: str | None = None
    in_stock_only: bool = False

    def active(self) -> bool:
        return any(v not in (None, False) for v in asdict(self).values())

    def condition(self) -> Column:
        out = F.lit(True)
        if self.price_min is not None:
            out &= F.col("price_ron") >= self.price_min
        if self.price_max is not None:
            out &= F.col("price_ron") <= self.price_max
        for name in ("category", "brand", "color", "audience"):
            if (value := getattr(self, name)) is not None:
                # lower() is case folding but for a few letters such as sharp s, which are spelled out
                out &= F.replace(F.lower(F.col(name)), F.lit("ß"), F.lit("ss")) == value.casefold()
        if self.in_stock_only:
            out &= F.col("in_stock")
        return out


@dataclass
class SearchOutcome:
    """results: (query_id, rank, id, score, products' columns); evidence: a row per query with the route and certificates."""

    results: DataFrame
    evidence: DataFrame
    strategy: str
    latency_ms: dict[str, float] = field(default_factory=dict)
    #: The exact result of everything, if it was asked for, and the texts of queries 0, 1, ...
    oracle: DataFrame | None = None
    texts: list[str] | None = None


def _router_checksum(centroids: np.ndarray, order, bands) -> str:
    return files.sha256(json.dumps([np.round(centroids, 12).tolist(), [int(x) for x in order], list(bands)]))


class Catalog:
    def __init__(self, spark: SparkSession, path: str, provider: EmbeddingProvider, router: Router, manifest: dict):
        self.spark, self.path, self.provider, self.router, self.manifest = spark, path.rstrip("/"), provider, router, manifest

    # Build and load

    @classmethod
    def build(
        cls, spark: SparkSession, csv_path: str, output: str, *, config: RouterConfig | None = None, provider: EmbeddingProvider | None = None, provider_name: str = "hash", dimension: int = 384,
        model: str | None = None, strict: bool = False, force_embeddings: bool = False, local_index: str = "exact", iterations: int = 20,
    ) -> Catalog:
        products, bad, report = catalog_csv.load(spark, csv_path, strict)
        return cls.build_from(products, output, config=config, provider=provider, provider_name=provider_name, dimension=dimension, model=model, rejects=bad, report=report, force_embeddings=force_embeddings, local_index=local_index, iterations=iterations)

    @classmethod
    def build_from(
        cls, products: DataFrame, output: str, *, config: RouterConfig | None = None, provider: EmbeddingProvider | None = None, provider_name: str = "hash", dimension: int = 384, model: str | None = None,
        rejects: DataFrame | None = None, report: dict | None = None, force_embeddings: bool = False, local_index: str = "exact", iterations: int = 20,
    ) -> Catalog:
        spark, output = products.sparkSession, output.rstrip("/")
        provider = provider or create_provider(provider_name, dimension, model)
        products.write.mode("overwrite").parquet(f"{output}/products")
        products = spark.read.parquet(f"{output}/products")
        if rejects is not None:
            rejects.write.mode("overwrite").parquet(f"{output}/rejects")
        products.select("product_id", catalog_csv.semantic_text().alias("semantic_text")).write.mode("overwrite").json(f"{output}/semantic_texts")
        embedded, cached = cls._embeddings(products, output, provider, force_embeddings)
        count = products.count()
        config = config or RouterConfig()
        if config.shards > count:
            config = replace(config, shards=count, probe_shards=min(config.probe_shards, count))
        clustered = shards.kmeans_shards(embedded, config.shards, config.seed, iterations)
        shards.dealt(clustered).write.mode("overwrite").partitionBy("shard_id").parquet(f"{output}/vectors")
        table = shards.shard_table(spark.read.parquet(f"{output}/vectors"))
        table.coalesce(1).write.mode("overwrite").parquet(f"{output}/shards")
        router = cls._router(spark, output, config)
        stored = cls._stored_index(spark, output, local_index, count, config)
        files.write_json(spark, f"{output}/import_report.json", (report or {}) | {"products": count})
        manifest = {
            "version": VERSION, "created_at": datetime.now(UTC).isoformat(), "provider": provider_name, "provider_id": provider.provider_id, "model": model, "dimension": provider.dimension, "products": count,
            "config": asdict(config), "embeddings_cached": cached, "local_index": checked_backend(local_index), "stored_index": stored, "order": router.order.tolist(), "router_checksum": _router_checksum(router.centroids, router.order, router.bands),
        }
        files.write_json(spark, f"{output}/router.json", {"order": manifest["order"], "bands": list(router.bands), "stats": router.stats(), "checksum": manifest["router_checksum"]})
        files.write_json(spark, f"{output}/catalog_manifest.json", manifest)
        return cls(spark, output, provider, router, manifest)

    @staticmethod
    def _embeddings(products: DataFrame, output: str, provider: EmbeddingProvider, force: bool) -> tuple[DataFrame, bool]:
        """(id, vector) of all products: read again if the same texts were embedded by the same provider before."""
        spark = products.sparkSession
        texts = products.select(F.col("product_id").alias("id"), catalog_csv.semantic_text().alias("text"))
        key = files.sha256(f"{files.table_checksum(texts)}|{provider.provider_id}")
        note, path = f"{output}/embedding_cache.json", f"{output}/embeddings"
        cached = not force and files.exists(spark, note) and files.read_json(spark, note).get("cache_key") == key
        if not cached:
            embed(texts, "text", provider, "vector").select("id", "vector").write.mode("overwrite").parquet(path)
            files.write_json(spark, note, {"cache_key": key, "provider_id": provider.provider_id, "dimension": provider.dimension})
        return spark.read.parquet(path), cached

    @staticmethod
    def _stored_index(spark: SparkSession, output: str, local_index: str, count: int, config: RouterConfig) -> dict | None:
        """Write the local index, where searches will take the approximate form."""
        if chosen_backend(local_index, count, config.shards) != "lsh" or config.metric != "cosine":
            return None
        return write_index(spark.read.parquet(f"{output}/vectors"), f"{output}/local_index", seed=config.seed)

    @staticmethod
    def _router(spark: SparkSession, path: str, config: RouterConfig, order=None) -> Router:
        table = spark.read.parquet(f"{path}/shards")
        _, centers = shards.matrix(table, "shard_id", "centroid")
        radii = [r[0] for r in table.orderBy("shard_id").select("euclidean_radius").collect()]
        return Router.fit(centers, config, order, np.array(radii, float))

    @classmethod
    def load(cls, spark: SparkSession, path: str, provider: EmbeddingProvider | None = None) -> Catalog:
        path = path.rstrip("/")
        manifest = files.read_json(spark, f"{path}/catalog_manifest.json")
        if manifest["version"] != VERSION:
            raise ValueError(f"the catalog has version {manifest['version']}, not {VERSION}")
        config = RouterConfig(**{**manifest["config"], "bands": tuple(manifest["config"]["bands"])})
        router = cls._router(spark, path, config, manifest["order"])
        if _router_checksum(router.centroids, router.order, router.bands) != manifest["router_checksum"]:
            raise ValueError("the router's files do not have the checksum of the manifest")
        provider = provider or create_provider(manifest["provider"], manifest["dimension"], manifest["model"])
        if provider.provider_id != manifest["provider_id"]:
            raise ValueError(f"the catalog was built with {manifest['provider_id']}")
        found = cls(spark, path, provider, router, manifest)
        check_consistency(found.vectors(), router.shards, router.centroids.shape[1])
        if (numbers := manifest.get("stored_index")) and (found.index_rows().count() != numbers["entries"] or numbers["dimension"] != router.centroids.shape[1]):
            raise ValueError("the stored local index is not that of the vectors")
        return found

    # Tables

    def products(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/products")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def index_rows(self) -> DataFrame:
        """(shard_id, bucket, id) of the stored local index."""
        return self.spark.read.parquet(f"{self.path}/local_index")

    def shard_rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/shards")

    def queries(self, texts: list[str]) -> DataFrame:
        """(query_id, vector) of texts, numbered from 0."""
        return self.spark.createDataFrame([(i, [float(x) for x in self.provider.encode_query(t)]) for i, t in enumerate(texts)], "query_id long, vector array<double>")

    # Search

    def search_text(self, texts: str | list[str], **options) -> SearchOutcome:
        texts = [texts] if isinstance(texts, str) else texts
        if any(not t.strip() for t in texts):
            raise ValueError("a query is blank")
        outcome = self.search(self.queries(texts), **options)
        outcome.texts = texts
        return outcome

    def search_vector(self, vector, **options) -> SearchOutcome:
        return self.search(self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, vector array<double>"), **options)

    def search(self, queries: DataFrame, *, top_k: int = 10, probe_shards: int | None = None, all_results: bool = False, filters: Filters = Filters(), strategy: str = "pre", evaluate: bool = False, local_index: str | None = None) -> SearchOutcome:
        """Search for a table of queries (query_id, vector).

        pre: filter, then rank. post: rank the routed shards, then filter; the evidence says how many rounds of a budget of five
        times top_k, doubled until enough passed, would have been needed. Both return the same rows. all_results: every matching product of every
        shard. evaluate: compare with an exact search of everything. local_index: how the routed shards are searched, exact, lsh (approximate, cosine
        only) or auto (by their size), by default as the catalog was built; the evidence names the one taken, and with lsh no vector certificate is given."""
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        if strategy not in ("pre", "post"):
            raise ValueError("strategy must be pre or post")
        began = perf_counter()
        blocks = list(search.query_blocks(queries))
        if len(blocks) > 1:
            raise ValueError(f"a batch of queries may have {search.QUERY_BYTES} bytes; send several")
        block = blocks[0]
        ids, matrix = block["query_id"].tolist(), np.stack(block["vector"].to_numpy()).astype(float)
        probe = self.router.shards if all_results else probe_shards
        unit = self.router.prepared(matrix)
        routes = self._routed(ids, matrix, probe)
        routed = {r[0]: set(r[1]) for r in routes}
        routing_ms = (perf_counter() - began) * 1000
        units = self.spark.createDataFrame([(q, v.tolist()) for q, v in zip(ids, unit, strict=True)], "query_id long, vector array<double>")
        allowed = self.vectors()
        if filters.active():
            allowed = allowed.join(self.products().where(filters.condition()).select(F.col("product_id").alias("id")), "id", "left_semi")
        metric, backend = self.router.config.metric, "exact"
        if all_results:
            found = search.all_ranked(allowed, units)
        else:
            backend = chosen_backend(local_index or self.manifest.get("local_index", "exact"), self.manifest["products"], self.router.shards)
            if backend == "lsh" and metric == "cosine":
                pairs = self.spark.createDataFrame([(q, s) for q, x in routed.items() for s in x], "query_id long, shard_id int")
                some = F.col("shard_id").isin(sorted({s for x in routed.values() for s in x}))
                if numbers := self.manifest.get("stored_index"):
                    found = stored_topk(self.index_rows().where(some), numbers, allowed.where(some), units, top_k, pairs)
                else:
                    found = lsh_topk(allowed.where(some), units, top_k, routes=pairs)
            else:
                backend = "exact"
                found = search.block_topk(allowed, units, top_k, metric, routed)
        found = found.persist()
        products = self.products().withColumnRenamed("product_id", "id")
        results = found.join(products, "id").orderBy("query_id", "rank")
        evidence = self._evidence(routes, found, top_k).withColumn("local_index", F.lit(backend))
        if backend != "exact":
            evidence = evidence.withColumn("vectors_certified", F.lit(False))
        if strategy == "post" and filters.active() and not all_results:
            evidence = evidence.join(self._rounds(units, routed, allowed, top_k, metric), "query_id", "left")
        everything = None
        if evaluate:
            everything = search.block_topk(allowed, units, top_k, metric)
            measured = search.recall_precision(found.where(F.col("rank") <= top_k), everything, top_k)
            evidence = evidence.join(measured, "query_id", "left")
        else:
            evidence = evidence.withColumns({"recall": F.lit(None).cast("double"), "precision": F.lit(None).cast("double")})
        return SearchOutcome(results, evidence, strategy, {"routing": routing_ms, "total": (perf_counter() - began) * 1000}, everything)

    def _routed(self, ids: list, matrix: np.ndarray, probe: int | None) -> list[tuple]:
        """A row per query: the route, the number of shards left out and what the best vector of them could score (bounds.ball_bounds in NumPy; null if a
        radius is unknown). Queries are routed a few at a time, so that no matrix of all queries by all shards is made."""
        router, rows = self.router, []
        radii = np.full(router.shards, np.nan) if router.radii is None else router.radii
        for lo in range(0, len(ids), router.some_queries):
            part = matrix[lo : lo + router.some_queries]
            routes = router.route(part, probe)
            skipped = np.ones(routes.upper.shape, bool)
            np.put_along_axis(skipped, routes.shard_ids, False, axis=1)
            if router.config.metric == "cosine":
                norms = np.ones(len(part)) if router.config.normalize else np.linalg.norm(part, axis=1)
                limit = routes.upper + norms[:, None] * radii[None, :]
                limit = np.clip(limit, -1, 1) if router.config.normalize else limit
            else:
                limit = routes.upper + 0 * radii[None, :]  # such scores bound the members already, if the radius is known
            best = np.where(skipped, limit, -np.inf).max(axis=1)  # NaN if a radius is unknown
            rows += [
                (q, [int(s) for s in routes.shard_ids[i]], int(routes.used_band[i]), bool(routes.certified[i]), bool(routes.fallback[i]), routes.modes[i], int(skipped[i].sum()), None if np.isnan(best[i]) else float(best[i]))
                for i, q in enumerate(ids[lo : lo + router.some_queries])
            ]
        return rows

    def _evidence(self, rows: list[tuple], found: DataFrame, k: int) -> DataFrame:
        """Per query the route, and whether the shards left out can hold nothing better than rank k of the filtered result."""
        table = self.spark.createDataFrame(rows, "query_id long, shard_ids array<int>, used_band int, certified boolean, fallback boolean, route_mode string, skipped int, best_skipped double")
        kth = found.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("kth_score"))
        sure = (F.col("skipped") == 0) | F.coalesce(F.col("best_skipped") <= F.col("kth_score"), F.lit(False))
        return table.join(kth, "query_id", "left").withColumn("vectors_certified", sure).drop("skipped", "best_skipped", "kth_score")

    def _rounds(self, units: DataFrame, routed: dict, allowed: DataFrame, k: int, metric: str) -> DataFrame:
        """(query_id, budget_rounds): budgets of 5k, 10k, ... that rank-then-filter needs for k results or all of its shards."""
        found = search.block_topk(allowed, units, k, metric, routed)
        rows = self.vectors().where(F.col("shard_id").isin(sorted({s for x in routed.values() for s in x})))
        at = search.places(rows, search.kth_results(found, units, k), routed, metric)
        return at.select("query_id", search.budget_rounds(F.col("place"), F.col("capacity"), k).alias("budget_rounds"))

    # Reports

    def log_evaluation(self, outcome: SearchOutcome, path: str) -> None:
        """Append a row of EVALUATION_FIELDS for each query to a log: CSV files with a header where the path ends in .csv, else Parquet."""
        began = perf_counter()
        outcome.results.count()
        local_ms = (perf_counter() - began) * 1000
        listed = lambda df, name: df.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])).alias(name))
        rows = outcome.evidence.join(listed(outcome.results, "result_product_ids"), "query_id", "left")
        if outcome.oracle is not None:
            rows = rows.join(listed(outcome.oracle, "oracle_product_ids"), "query_id", "left")
        else:
            rows = rows.withColumn("oracle_product_ids", F.lit(None).cast("string"))
        texts = self.spark.createDataFrame(list(enumerate(outcome.texts or [])), "query_id long, query string")
        named = rows.join(texts, "query_id", "left").select(
            F.coalesce("query", F.lit("<vector query>")).alias("query"), F.to_json("shard_ids").alias("selected_shards"), "used_band", "route_mode", "certified", F.col("vectors_certified").alias("vector_pruning_certified"), "fallback",
            F.lit(outcome.latency_ms["routing"]).alias("routing_latency_ms"), F.lit(local_ms).alias("local_search_latency_ms"), F.lit(outcome.latency_ms["total"] + local_ms).alias("total_latency_ms"),
            F.coalesce("result_product_ids", F.lit("[]")).alias("result_product_ids"), "oracle_product_ids", F.col("recall").alias("recall_at_k"), F.col("precision").alias("precision_at_k"), F.lit(outcome.strategy).alias("filter_strategy"),
        )
        out = named.select(*EVALUATION_FIELDS).coalesce(1).write.mode("append")
        out.option("header", True).option("escape", "\"").csv(path) if path.endswith(".csv") else out.parquet(path)

    def stats(self) -> dict:
        return {"products": self.manifest["products"], "provider": self.manifest["provider_id"], "router": self.router.stats()}


def result_json(results: DataFrame) -> DataFrame:
    """(query_id, rank, json): a product with its score."""
    return results.select("query_id", "rank", F.to_json(F.struct(*[c for c in results.columns if c not in ("query_id", "rank")])).alias("json"))


def page(results: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of each query's ranking."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return results.where(F.col("rank").between((number - 1) * size + 1, number * size))


def format_price(value: float | None) -> str:
    return "preț indisponibil" if value is None else f"{value:,.2f} RON"


def format_results(outcome: SearchOutcome, limit: int = 50) -> str:
    """A text report of the first `limit` rows of each query."""
    lines = []
    for row in outcome.evidence.orderBy("query_id").collect():
        lines.append(f"Interogare {row['query_id']}: mod {row['route_mode']}, banda {row['used_band']}, {len(row['shard_ids'])} sharduri, certificat {'da' if row['certified'] else 'nu'}")
        lines += [f"{r['rank']:>4}. {r['title']} | {r['brand'] or '-'} | {format_price(r['price_ron'])} | {r['score']:.4f}" for r in outcome.results.where((F.col("query_id") == row["query_id"]) & (F.col("rank") <= limit)).orderBy("rank").collect()]
    return "\n".join(lines)
