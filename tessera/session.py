"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver did; on a cluster it is installed or shipped."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    return spark
