"""A synthetic catalog of any size from integer mixing: the same rows for the same seed, made where they are needed."""

from __future__ import annotations

import os
import sqlite3
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of the mixing.
STEP, SEED_STEP, CATEGORY_STEP, SKEW, STOCK_CYCLE = 1103515245, 12345, 2654435761, 1.35, 13
COLORS = ("negru", "alb", "gri", "roșu", "albastru", "verde", "galben", "maro", "bej", "mov", "portocaliu", "argintiu")
SERIES = ("Start", "Plus", "Max", "Pro", "Ultra", "Neo", "Air", "Eco")
AUDIENCES = ("unisex", "femei", "bărbați", "copii", "familie")
FEATURES = ("baterie de durată", "materiale reciclate", "montare ușoară", "garanție extinsă", "consum redus", "design compact", "protecție la apă", "reglaj fin")
#: Names of departments, each with the beginning of its brands, and of their subcategories.
DEPARTMENTS = (
    ("Telefonie", "Vox"), ("Calculatoare", "Byt"), ("Sunet", "Son"), ("Imagine", "Lum"), ("Electrocasnice", "Cas"), ("Mobilier", "Lem"), ("Bucătărie", "Gus"), ("Curte", "Ver"),
    ("Mișcare", "Vel"), ("Haine", "Tex"), ("Pantofi", "Pas"), ("Jocuri", "Jov"), ("Cărți", "Pag"), ("Mașini", "Mot"), ("Igienă", "Pur"), ("Papetărie", "Scr"),
)
RANGES = ("de bază", "compacte", "premium", "pentru copii", "profesionale", "de exterior", "de drum", "portabile", "clasice", "moderne", "la set", "cu accesorii", "de rezervă", "de sezon", "noi", "ecologice")
USES = ("uz zilnic", "birou", "călătorii", "sport", "casă", "grădină", "școală", "cadouri")


@dataclass(frozen=True)
class Taxonomy:
    """Departments times subcategories; a department's price range follows from its number, and it has brands of its own."""

    departments: int = 16
    subcategories: int = 16
    brands: int = 8

    @property
    def size(self) -> int:
        return self.departments * self.subcategories


def _pick(values: tuple[str, ...], shift: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.shiftright("mixed", shift) % len(values) + 1).cast("int"))


def categories(spark: SparkSession, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """(category_id, department, subcategory, category, price_min, price_max, brand_stem)."""
    department = (F.floor(F.col("id") / taxonomy.subcategories) + 1).cast("int")
    sub = (F.col("id") % taxonomy.subcategories + 1).cast("int")
    base = spark.range(taxonomy.size).select((F.col("id") + 1).cast("int").alias("category_id"), department.alias("d"), sub.alias("s"))

    def named(words: tuple[str, ...], number: str) -> Column:
        """The number's word; a further round through the words adds its number."""
        again = F.floor((F.col(number) - 1) / len(words)).cast("int")
        return F.concat(F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(number) - 1) % len(words) + 1), F.when(again > 0, F.concat(F.lit(" "), (again + 1).cast("string"))).otherwise(""))

    whole = base.select("category_id", "d", named(tuple(n for n, _ in DEPARTMENTS), "d").alias("department"), named(RANGES, "s").alias("range"), named(tuple(b for _, b in DEPARTMENTS), "d").alias("brand_stem"))
    whole = whole.withColumn("subcategory", F.concat_ws(" ", "department", "range"))
    return whole.select("category_id", "department", "subcategory", F.concat_ws(" > ", "department", "subcategory").alias("category"), (F.col("d") * 5.0).alias("price_min"), (F.col("d") * 500.0).alias("price_max"), "brand_stem")


def products(spark: SparkSession, rows: int, seed: int = 42, taxonomy: Taxonomy = Taxonomy(), category_count: int | None = None) -> DataFrame:
    """Products P0000001 on: categories in turn, everything else from the mixed number of the row."""
    count = category_count or taxonomy.size
    if not 1 <= count <= taxonomy.size:
        raise ValueError(f"the number of categories must be between 1 and {taxonomy.size}")
    category = F.col("id") % count + 1
    mixed = (F.col("id") * F.lit(STEP) + F.lit(seed * SEED_STEP) + category * F.lit(CATEGORY_STEP)).bitwiseAND(F.lit(MASK))
    numbered = spark.range(rows).select("id", category.cast("int").alias("category_id"), mixed.alias("mixed"), (F.floor(F.col("id") / count) + 1).alias("sequence"))
    joined = numbered.join(categories(spark, taxonomy), "category_id")
    share = F.pow((F.col("mixed") % 10000) / F.lit(9999.0), F.lit(SKEW))
    price = F.round(F.col("price_min") + (F.col("price_max") - F.col("price_min")) * share, 2)
    brand = F.concat(F.col("brand_stem"), F.lit(" "), F.chr((F.lit(65) + F.col("mixed") % taxonomy.brands).cast("int")))
    made = joined.select(
        "id", "category_id", "category", "subcategory", "sequence", brand.alias("brand"), price.alias("price_ron"), _pick(SERIES, 4).alias("series"), _pick(COLORS, 8).alias("color"),
        _pick(AUDIENCES, 12).alias("audience"), _pick(FEATURES, 16).alias("feature_one"), _pick(FEATURES, 21).alias("feature_two"), _pick(USES, 25).alias("use"),
        ((F.col("mixed") + F.col("category_id")) % STOCK_CYCLE != 0).alias("in_stock"),
    )
    title = F.concat_ws(" ", "subcategory", "brand", "series", F.lpad(F.col("sequence").cast("string"), 4, "0"))
    text = F.concat(F.col("subcategory"), F.lit(", seria "), F.col("series"), F.lit(", pentru "), F.col("use"), F.lit(". Cu "), F.col("feature_one"), F.lit(" și "), F.col("feature_two"), F.lit(", "), F.col("color"), F.lit("."))
    return made.select(
        F.concat(F.lit("P"), F.lpad((F.col("id") + 1).cast("string"), 7, "0")).alias("product_id"), title.alias("title"), text.alias("description"), "category_id", "category", "brand", "price_ron", "color", "audience", "in_stock"
    )


def constraint_checks(made: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row: how many rows break the keys and checks of a relational copy, and how even the categories are."""
    repeated = made.groupBy("product_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    orphans = made.join(taxonomy, "category_id", "left_anti").agg(F.count("*").alias("orphans"))
    bad = made.agg(F.count("*").alias("products"), F.count_if(~(F.col("price_ron") >= 0)).alias("bad_prices"), F.count_if(F.col("in_stock").isNull()).alias("bad_stock"))
    sizes = made.groupBy("category").agg(F.count("*").alias("n")).agg(F.count("*").alias("categories"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return bad.crossJoin(repeated).crossJoin(orphans).crossJoin(sizes)  # four tables of one row


def write_catalog(made: DataFrame, path: str, force: bool = False) -> None:
    """The CSV copy, a directory of files with headers; it is not overwritten unless force is set."""
    made.drop("category_id").withColumn("in_stock", F.col("in_stock").cast("int")).write.mode("overwrite" if force else "error").csv(path, header=True, escape='"')


def write_sqlite(made: DataFrame, taxonomy: DataFrame, path: str, force: bool = False, batch: int = 10_000) -> int:
    """A local SQLite copy with keys and indexes, streamed through the driver in batches; returns its number of products."""
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    beside = path + ".part"
    if os.path.exists(beside):
        os.remove(beside)
    con = sqlite3.connect(beside)
    try:
        con.execute("PRAGMA foreign_keys = ON")
        con.execute("CREATE TABLE categories (category_id INTEGER PRIMARY KEY, department TEXT NOT NULL, subcategory TEXT NOT NULL, category TEXT NOT NULL UNIQUE, price_min REAL NOT NULL, price_max REAL NOT NULL)")
        con.execute(
            "CREATE TABLE products (product_id TEXT PRIMARY KEY, title TEXT NOT NULL, description TEXT NOT NULL, category_id INTEGER NOT NULL REFERENCES categories, category TEXT NOT NULL, brand TEXT NOT NULL, "
            "price_ron REAL NOT NULL CHECK (price_ron >= 0), color TEXT NOT NULL, audience TEXT NOT NULL, in_stock INTEGER NOT NULL CHECK (in_stock IN (0, 1)))"
        )
        con.executemany("INSERT INTO categories VALUES (?, ?, ?, ?, ?, ?)", [tuple(r)[:6] for r in taxonomy.collect()])
        held = []
        for row in made.toLocalIterator():
            held.append(tuple(int(x) if isinstance(x, bool) else x for x in row))
            if len(held) == batch:
                con.executemany(f"INSERT INTO products VALUES ({', '.join('?' * 10)})", held)
                held.clear()
        con.executemany(f"INSERT INTO products VALUES ({', '.join('?' * 10)})", held)
        for column in ("category_id", "brand", "price_ron", "in_stock"):
            con.execute(f"CREATE INDEX products_{column} ON products ({column})")
        con.commit()
        count = con.execute("SELECT count(*) FROM products").fetchone()[0]
    finally:
        con.close()
    os.replace(beside, path)
    return count
