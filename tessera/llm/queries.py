"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_content, language_model, mixing, near_duplicates, nearest, personal_data, quality, secrets, token_output
from tessera.llm.shared import documents, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(documents(spark, sf_dir))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(documents(spark, sf_dir))


def op9_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.main_text(table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.spans(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_secrets, op2_mixing, op3_nearest, op4_decontamination, op5_near_duplicates, op6_quality, op7_token_output, op8_language_model, op9_html_content, op10_personal_data)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE_SQL}
