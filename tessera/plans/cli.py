"""Command line: build, search, interactive, benchmark-csv, serve."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from tessera.operators.local_index import BACKENDS
from tessera.operators.router import RouterConfig
from tessera.plans import benchmark, interactive
from tessera.plans.catalog import Catalog, Filters, format_results, result_json
from tessera.sources import catalog_csv

STREAMING_BYTES = 64 << 20


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x.strip())


def _filter_arguments(p: argparse.ArgumentParser) -> None:
    for name in ("price-min", "price-max"):
        p.add_argument(f"--{name}", type=float)
    for name in ("category", "brand", "color", "audience"):
        p.add_argument(f"--{name}")
    p.add_argument("--in-stock-only", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build a catalog from a CSV file")
    build.add_argument("--csv", required=True)
    build.add_argument("--output", required=True)
    build.add_argument("--shards", type=int, default=256)
    build.add_argument("--bands", type=_numbers, default=(8, 16, 32, 64, 128))
    build.add_argument("--probe-shards", type=int, default=16)
    build.add_argument("--ordering", default="recursive_pca")
    build.add_argument("--embedding-provider", default="hash")
    build.add_argument("--embedding-model")
    build.add_argument("--embedding-dimension", type=int, default=384)
    build.add_argument("--embedding-batch-size", type=int, default=64, help="texts that an embedding model takes at once")
    build.add_argument("--local-index", choices=BACKENDS, default="exact", help="how searches look into shards by default")
    build.add_argument("--strict-csv", action="store_true")
    build.add_argument("--force-embeddings", action="store_true")
    build.add_argument("--seed", type=int, default=42)
    build.add_argument("--max-spectral-attempts", type=int, default=2)
    build.add_argument("--streaming", action=argparse.BooleanOptionalAction, default=None, help="bounded passes over the file; the default for files of 64 MiB and more")
    build.add_argument("--batch-size", type=int, default=10_000, help="rows that a Python worker gets at once")
    build.add_argument("--kmeans-epochs", type=int, help="rounds of clustering; by default 20")
    build.add_argument("--progress-every", type=int, default=50_000, help="records between two lines of progress of a streaming build; 0: none")
    find = commands.add_parser("search", help="search a catalog")
    find.add_argument("--index", required=True)
    find.add_argument("--query", required=True)
    find.add_argument("--top-k", type=int, default=10)
    find.add_argument("--probe-shards", type=int)
    find.add_argument("--all-results", action="store_true")
    find.add_argument("--all-shards", action="store_true")
    find.add_argument("--filter-strategy", choices=("pre", "post"), default="post")
    find.add_argument("--evaluate", action="store_true")
    find.add_argument("--report", help="a log to append the evaluation to: CSV files if it ends in .csv, else Parquet")
    find.add_argument("--local-index", choices=BACKENDS)
    find.add_argument("--json", action="store_true", dest="as_json")
    _filter_arguments(find)
    live = commands.add_parser("interactive", aliases=("live", "cauta"), help="open a search session")
    live.add_argument("--index", default="artifacts/products")
    live.add_argument("--top-k", type=int, default=10)
    live.add_argument("--probe-shards", type=int)
    live.add_argument("--top-only", action="store_true")
    live.add_argument("--page-size", type=int, default=10)
    live.add_argument("--report", help="a log to append an evaluation of each search to")
    _filter_arguments(live)
    bench = commands.add_parser("benchmark-csv", help="measure a catalog against an exact search")
    bench.add_argument("--csv", required=True)
    bench.add_argument("--queries", required=True)
    bench.add_argument("--artifacts", default="artifacts/benchmark_products")
    bench.add_argument("--output", default="reports")
    bench.add_argument("--shards", type=int, default=8)
    bench.add_argument("--probe-values", type=_numbers, default=(2, 4, 8))
    bench.add_argument("--bands", type=_numbers, default=(1, 2, 4))
    bench.add_argument("--top-k", type=int, default=5)
    bench.add_argument("--seed", type=int, default=42)
    bench.add_argument("--max-spectral-attempts", type=int, default=0)
    serve = commands.add_parser("serve", help="answer HTTP requests")
    serve.add_argument("--index")
    serve.add_argument("--port", type=int, default=8080)
    return top


def _filters(a: argparse.Namespace) -> Filters:
    return Filters(a.price_min, a.price_max, a.category, a.brand, a.color, a.audience, a.in_stock_only)


def _build(spark: SparkSession, a: argparse.Namespace) -> str:
    config = RouterConfig(shards=a.shards, bands=a.bands, probe_shards=min(a.probe_shards, a.shards), ordering=a.ordering, seed=a.seed, max_attempts=a.max_spectral_attempts)
    options = {"config": config, "provider_name": a.embedding_provider, "dimension": a.embedding_dimension, "model": a.embedding_model, "local_index": a.local_index}
    if a.kmeans_epochs:
        options["iterations"] = a.kmeans_epochs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(a.batch_size))
    if a.embedding_provider not in ("hash", "fast-hash", "fast_hash"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(a.batch_size, a.embedding_batch_size)))
    large = os.path.isfile(a.csv) and os.path.getsize(a.csv) >= STREAMING_BYTES
    if large if a.streaming is None else a.streaming:
        from tessera.streaming.build import build_streaming

        catalog = build_streaming(spark, a.csv, a.output, progress=lambda n: print(f"{n} records"), progress_every=a.progress_every, **options)
    else:
        catalog = Catalog.build(spark, a.csv, a.output, strict=a.strict_csv, force_embeddings=a.force_embeddings, **options)
    return json.dumps(catalog.stats(), default=str, indent=2)


def _search(spark: SparkSession, a: argparse.Namespace) -> str:
    catalog = Catalog.load(spark, a.index)
    probe = catalog.router.shards if a.all_shards else a.probe_shards
    outcome = catalog.search_text(a.query, top_k=a.top_k, probe_shards=probe, all_results=a.all_results, filters=_filters(a), strategy=a.filter_strategy, evaluate=a.evaluate, local_index=a.local_index)
    if a.report:
        catalog.log_evaluation(outcome, a.report)
    if a.as_json:
        route = outcome.evidence.first().asDict()
        return json.dumps({"query": a.query, "route": route, "results": [json.loads(r["json"]) for r in result_json(outcome.results).orderBy("rank").collect()]}, ensure_ascii=False, default=str)
    return format_results(outcome)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "build":
        print(_build(spark, a))
    elif a.command == "search":
        print(_search(spark, a))
    elif a.command in ("interactive", "live", "cauta"):
        session = interactive.Session(not a.top_only, a.top_k, a.probe_shards, a.page_size, _filters(a))
        interactive.run(Catalog.load(spark, a.index), session, report=a.report)
    elif a.command == "benchmark-csv":
        config = RouterConfig(shards=a.shards, bands=a.bands, probe_shards=min(max(a.probe_values), a.shards), seed=a.seed, max_attempts=a.max_spectral_attempts)
        catalog = Catalog.build(spark, a.csv, a.artifacts, config=config)
        report = benchmark.catalog_benchmark(catalog, catalog_csv.read_queries(spark, a.queries), a.probe_values, a.top_k)
        benchmark.write_report(spark, report, a.output)
        print(json.dumps(report, indent=2))
    else:
        from tessera.plans.http_api import serve

        serve(spark, a.index, a.port)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
