"""Bounded builds: a catalog from a stream of product files.

The input files are first cut at record borders into parts of PART_BYTES with numbered records: one pass over the bytes a file, which holds no more than a record, so
that one large file with line breaks in fields is no longer one task. First pass: availableNow micro-batches validate, embed and append the
products, their semantic texts and the rejects; ids that an earlier batch holds are duplicates. Second pass: k-means on the written vectors,
then micro-batches assign and append them to their shards. Each batch is an ordinary DataFrame job that replaces what an earlier attempt wrote, so memory is bounded by the
batch, and a checkpoint lets a stopped build go on. An input that changes between the passes is an error. The result is that of the
batch build with the same centers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import EmbeddingProvider, create_provider, embed
from tessera.operators import shards
from tessera.operators.local_index import checked_backend
from tessera.operators.router import RouterConfig
from tessera.plans.catalog import VERSION, Catalog, _router_checksum
from tessera.session import with_package
from tessera.sources import catalog_csv, files


PART_BYTES = 32 << 20
_WHOLE = ("product_id is empty", "title is empty", "description is empty")


def _run(stream: DataFrame, each, checkpoint: str) -> None:
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def input_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of a CSV file, a pattern, or the files of a directory."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*") if fs.exists(at) and fs.getFileStatus(at).isDirectory() else at
    found = [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.globStatus(pattern) or [] if x.isFile()]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a CSV file: lines, joined while a quoted field is open (an odd number of quotes so far). Blank ones are skipped."""
    rest, open_record = b"", b""
    for chunk in chunks:
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop()
        for line in lines:
            open_record += line + b"\n"
            if open_record.count(b'"') % 2 == 0:
                if open_record.strip():
                    yield open_record
                open_record = b""
    if (open_record + rest).strip():
        yield open_record + rest


def split_files(spark: SparkSession, paths: list[str], folder: str, part_bytes: int = PART_BYTES) -> None:
    """Write the records of each file, with a column line_number, into parts below folder; files are cut in parallel. Parts get their
    names when they are whole, and a repeated task writes the same parts."""

    def cut(frames):
        for frame in frames:
            for number, path in zip(frame["number"].tolist(), frame["path"].tolist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                target, base = pafs.FileSystem.from_uri(folder)
                target.create_dir(base, recursive=True)
                part, out, size, header = 0, None, 0, None

                def close() -> None:
                    nonlocal out, size, part
                    if out is not None:
                        out.close()
                        target.move(name, f"{base}/file-{number:06d}-part-{part:06d}.csv")
                        part, out, size = part + 1, None, 0

                with fs.open_input_stream(at) as source:
                    for line, record in enumerate(records(iter(lambda: source.read(1 << 20), b"")), 1):
                        if header is None:
                            header = b"line_number," + record.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r\n") + b"\n"
                            continue
                        if out is None:
                            name = f"{base}/_{uuid.uuid4().hex}.tmp"
                            out = target.open_output_stream(name)
                            out.write(header)
                        out.write(f"{line},".encode() + record.rstrip(b"\r\n") + b"\n")
                        size += len(record)
                        if size >= part_bytes:
                            close()
                if out is None and part == 0 and header is not None:
                    name = f"{base}/_{uuid.uuid4().hex}.tmp"
                    out = target.open_output_stream(name)
                    out.write(header)
                close()
                yield pd.DataFrame({"parts": [part]})

    rows = spark.createDataFrame(list(enumerate(paths)), "number int, path string").repartition(min(len(paths), 1000), "number")
    rows.mapInPandas(cut, "parts int").agg(F.sum("parts")).collect()


def stream_products(raw: DataFrame, output: str, provider: EmbeddingProvider, progress: Callable[[int], None] | None = None, progress_every: int = 0) -> None:
    """Append the valid products of a stream of raw rows, their texts and embeddings, and the rejects. A batch that is repeated replaces what it wrote.
    progress hears the number of records after each batch that passes a multiple of progress_every."""
    read = 0

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = catalog_csv.judged(catalog_csv.numbered(batch))
        earlier = f"{output}/products"
        if files.exists(spark, earlier):
            written = spark.read.schema(f"{catalog_csv.PRODUCT_SCHEMA}, batch long").parquet(earlier).where(F.col("batch") < number)
            rows = rows.join(written.select("product_id", F.lit(True).alias("seen")), "product_id", "left")
            again = F.col("seen") & ~F.coalesce(F.col("reject_reason"), F.lit("")).isin(*_WHOLE)
            rows = rows.withColumn("reject_reason", F.when(again, "duplicate product_id").otherwise(F.col("reject_reason")))
        rows = rows.persist()
        target = f"batch={number}"
        good = catalog_csv.valid_products(rows)
        good.write.mode("overwrite").parquet(f"{output}/products/{target}")
        catalog_csv.rejects(rows).write.mode("overwrite").parquet(f"{output}/rejects/{target}")
        good.select("product_id", catalog_csv.semantic_text().alias("semantic_text")).write.mode("overwrite").json(f"{output}/semantic_texts/{target}")
        text = good.select(F.col("product_id").alias("id"), catalog_csv.semantic_text().alias("text"))
        embed(text, "text", provider, "vector").select("id", "vector").write.mode("overwrite").parquet(f"{output}/embeddings/{target}")
        if progress and progress_every:
            nonlocal read
            before, read = read, read + rows.count()
            if read // progress_every > before // progress_every:
                progress(read)
        rows.unpersist()

    _run(raw, each, f"{output}/checkpoints/products")


def import_report(spark: SparkSession, output: str) -> dict:
    """Counts of what the first pass wrote."""
    good = spark.read.parquet(f"{output}/products").count()
    bad = spark.read.parquet(f"{output}/rejects").agg(F.count("*"), F.count_if(F.col("error") == "duplicate product_id")).first()
    return {"rows_read": good + bad[0], "rows_valid": good, "rows_invalid": bad[0], "duplicate_ids": bad[1]}


def stream_shards(spark: SparkSession, output: str, centers: np.ndarray) -> None:
    """Assign the written embeddings to centers, file by file."""
    stream = spark.readStream.schema("id string, vector array<double>").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 64).parquet(f"{output}/embeddings")

    def each(batch: DataFrame, number: int) -> None:
        shards.assign(batch, centers).drop("similarity").write.mode("overwrite").parquet(f"{output}/assigned/batch={number}")

    _run(stream, each, f"{output}/checkpoints/shards")


def build_streaming(
    spark: SparkSession, csv_path: str, output: str, *, config: RouterConfig | None = None, provider: EmbeddingProvider | None = None, provider_name: str = "hash", dimension: int = 384, model: str | None = None,
    part_bytes: int = PART_BYTES, files_a_batch: int = 8, local_index: str = "exact", iterations: int = 20, progress: Callable[[int], None] | None = None, progress_every: int = 0,
) -> Catalog:
    """A catalog from a CSV file or a directory of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    with_package(spark)
    output, provider = output.rstrip("/"), provider or create_provider(provider_name, dimension, model)
    before = input_files(spark, csv_path)
    if not files.exists(spark, f"{output}/input.json"):
        split_files(spark, [p for p, _, _ in before], f"{output}/input", part_bytes)
        files.write_json(spark, f"{output}/input.json", before)
    elif [tuple(x) for x in files.read_json(spark, f"{output}/input.json")] != before:
        raise ValueError("the input is not that of the build that was begun here")
    header = spark.read.csv(f"{output}/input", header=True, multiLine=True).columns
    schema = ", ".join(f"`{c}` string" for c in header)
    reader = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxFilesPerTrigger", files_a_batch)
    stream_products(reader.csv(f"{output}/input").toDF(*[c.strip() for c in header]), output, provider, progress, progress_every)
    if input_files(spark, csv_path) != before:
        raise ValueError("the input changed while it was read")
    report = import_report(spark, output)
    if not report["rows_valid"]:
        raise ValueError("the catalog holds no valid record")
    vectors = spark.read.schema("id string, vector array<double>").option("recursiveFileLookup", True).parquet(f"{output}/embeddings")
    count = vectors.count()
    config = config or RouterConfig()
    if config.shards > count:
        config = replace(config, shards=count, probe_shards=min(config.probe_shards, count))
    fitted = KMeans(k=config.shards, seed=config.seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="features").fit(vectors.select(array_to_vector("vector").alias("features")))
    centers = np.array([c / max(np.linalg.norm(c), 1e-300) for c in fitted.clusterCenters()])
    stream_shards(spark, output, centers)
    assigned = spark.read.schema("id string, vector array<double>, shard_id int").option("recursiveFileLookup", True).parquet(f"{output}/assigned")
    similarity = shards.assign(assigned.select("id", "vector"), centers)
    final = shards.repair_empty(similarity, config.shards).drop("similarity")
    shards.dealt(final).write.mode("overwrite").partitionBy("shard_id").parquet(f"{output}/vectors")
    shards.shard_table(spark.read.parquet(f"{output}/vectors")).coalesce(1).write.mode("overwrite").parquet(f"{output}/shards")
    router = Catalog._router(spark, output, config)
    manifest = {
        "version": VERSION, "provider": provider_name, "provider_id": provider.provider_id, "model": model, "dimension": provider.dimension, "products": count, "config": asdict(config), "embeddings_cached": False, "local_index": checked_backend(local_index), "stored_index": Catalog._stored_index(spark, output, local_index, count, config),
        "order": router.order.tolist(), "router_checksum": _router_checksum(router.centroids, router.order, router.bands), "streaming": True,
    }
    files.write_json(spark, f"{output}/import_report.json", report | {"products": count})
    files.write_json(spark, f"{output}/router.json", {"order": manifest["order"], "bands": list(router.bands), "stats": router.stats(), "checksum": manifest["router_checksum"]})
    files.write_json(spark, f"{output}/catalog_manifest.json", manifest)
    return Catalog(spark, output, provider, router, manifest)
