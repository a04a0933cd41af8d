"""What every corpus operator needs: the shared folder, materialised tables and partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import with_package

#: Rows that Spark hands to a Python worker at once; with long texts its default of 10,000 is hundreds of MB.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows (texts differ a lot in length, so the bound is low), and let workers import the package."""
    with_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where it is unset and all run in one process (as in tests) a new local one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark.sparkContext, "_tessera_shared", None)
        if at is None:
            at = spark.sparkContext._tessera_shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return at.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs nothing that was finished."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR overrides the installed package's."""
    if at := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(at, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """text with each span (kind, start, end in code points) replaced by its kind in brackets; what overlaps an earlier span goes with it."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        shown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, shown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(places, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def masked_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the spans of found (doc_id, base, added) masked in their texts. Ids must be unique; texts without spans are not touched."""
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = found.select(F.col("doc_id").alias("masked_id"), F.concat("base", plain).alias("masked_spans")).where(F.size("masked_spans") > 0)
    joined = docs.join(spans, docs["doc_id"] == spans["masked_id"], "left")
    new = F.when(F.col("masked_spans").isNotNull(), masked(docs["text"], F.col("masked_spans"))).otherwise(docs["text"])
    return joined.withColumn("text", new).select(*docs.columns)
