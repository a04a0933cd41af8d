"""Reading and validating product catalogs.

A raw catalog is a table of string columns with `line_number` (records from 2 on; blank rows are skipped and not counted). Every record gets a
reject_reason or none, in this order: an empty id, title or description; a duplicate of an earlier valid record; a bad price; a bad stock value. The
first fully valid record of an id wins; later complete ones are duplicates whatever their price and stock, earlier invalid ones keep their
reason. The first valid line of each id is an aggregate that is joined back, so an id with very many records gathers nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("product_id", "title", "description")
OPTIONAL = ("category", "brand", "price_ron", "color", "audience", "in_stock")
TRUE_WORDS = ("1", "true", "yes", "y", "da", "d")
FALSE_WORDS = ("0", "false", "no", "n", "nu")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

PRODUCT_SCHEMA = "product_id string, title string, description string, category string, brand string, price_ron double, color string, audience string, in_stock boolean"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The raw table of a CSV file with a header (quoted fields may hold line breaks; a byte-order mark is dropped).

    A file with line breaks in fields is one partition, which also gives the records their order; for many files each
    numbers its own records."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return numbered(raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns]))


def numbered(raw: DataFrame) -> DataFrame:
    """Known columns only, missing optional ones as null, and line numbers in the order of reading."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"the catalog lacks the columns {', '.join(missing)}")
    columns = [F.col(f"`{c}`").cast("string").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in (*REQUIRED, *OPTIONAL)]
    line = F.col("line_number") if "line_number" in raw.columns else F.monotonically_increasing_id() + 2
    return raw.select(line.cast("long").alias("line_number"), *columns)


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_price(c: Column) -> tuple[Column, Column]:
    """(price or null, whether the text is bad). Spaces go and a comma is a decimal point; it must be finite and not negative."""
    text = F.replace(F.replace(F.trim(c), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    price = F.when(text.rlike(NUMBER), text.try_cast("double"))
    blank = text_or_null(c).isNull()
    good = F.coalesce((price >= 0) & (price < float("inf")), F.lit(False))
    return F.when(~blank & good, price), ~blank & ~good


def parse_stock(c: Column) -> tuple[Column, Column]:
    """(in stock, whether the text is bad); blank means in stock."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    value = F.when((word == "") | word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return value, value.isNull()


def judged(raw: DataFrame) -> DataFrame:
    """raw, parsed, with reject_reason (null for valid records)."""
    price, bad_price = parse_price(F.col("price_ron"))
    stock, bad_stock = parse_stock(F.col("in_stock"))
    text = [text_or_null(F.col(c)).alias(c) for c in (*REQUIRED, "category", "brand", "color", "audience")]
    parsed = raw.select("line_number", *text, price.alias("price_ron"), bad_price.alias("bad_price"), stock.alias("in_stock"), bad_stock.alias("bad_stock"))
    whole = F.col("product_id").isNotNull() & F.col("title").isNotNull() & F.col("description").isNotNull()
    first = parsed.where(whole & ~F.col("bad_price") & ~F.col("bad_stock")).groupBy("product_id").agg(F.min("line_number").alias("first_line"))
    reason = (
        F.when(F.col("product_id").isNull(), "product_id is empty")
        .when(F.col("title").isNull(), "title is empty")
        .when(F.col("description").isNull(), "description is empty")
        .when(F.col("line_number") > F.col("first_line"), "duplicate product_id")
        .when(F.col("bad_price"), "price_ron is invalid")
        .when(F.col("bad_stock"), "in_stock is invalid")
    )
    return parsed.join(first, "product_id", "left").withColumn("reject_reason", reason)


def valid_products(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is null").select("product_id", "title", "description", "category", "brand", "price_ron", "color", "audience", "in_stock")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is not null").select("line_number", "product_id", F.col("reject_reason").alias("error"))


def report(rows: DataFrame) -> DataFrame:
    """One row of counts; duplicates count as invalid too."""
    bad = F.col("reject_reason").isNotNull()
    return rows.agg(
        F.count("*").alias("rows_read"), F.count_if(~bad).alias("rows_valid"), F.count_if(bad).alias("rows_invalid"),
        F.count_if(F.col("reject_reason") == "duplicate product_id").alias("duplicate_ids"),
    )


def load(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """(valid products, rejects, report). strict: the first bad record is an error; without any valid record it always is."""
    rows = judged(read_catalog(spark, path)).persist()
    counts = report(rows).first().asDict()
    if strict and counts["rows_invalid"]:
        worst = rejects(rows).orderBy("line_number").first()
        raise ValueError(f"line {worst['line_number']}: {worst['error']}")
    if not counts["rows_valid"]:
        raise ValueError("the catalog holds no valid record")
    return valid_products(rows), rejects(rows), counts


def semantic_text() -> Column:
    """What is embedded of a product; price and stock are filters, not text."""
    labels = {"title": "Titlu", "description": "Descriere", "category": "Categorie", "brand": "Brand", "color": "Culoare", "audience": "Public"}
    return F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c), F.lit("."))) for c, label in labels.items()])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of a CSV file with a column query; blank ones are skipped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').select(text_or_null(F.col("query")).alias("query"))
    return raw.where("query is not null").select(F.monotonically_increasing_id().alias("query_id"), "query")
