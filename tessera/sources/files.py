"""Small driver-side files through Hadoop's file systems, so that every path that Spark knows works."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside and rename, so that a reader never sees half a file."""
    p, fs = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=lambda x: x.item() if hasattr(x, "item") else x.tolist() if hasattr(x, "tolist") else str(x)))


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table_checksum(df: DataFrame) -> str:
    """A checksum of a table's rows, whatever their order; computed where the rows are."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    found = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return sha256("|".join(str(x) for x in found))
