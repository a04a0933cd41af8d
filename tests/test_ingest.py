import pytest

from tessera.sources import catalog_csv, files, generator


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_rules(spark, tmp_path):
    path = write(
        tmp_path / "c.csv",
        "﻿product_id, title,description,price_ron,in_stock\nP1,One,first,bad,da\nP1,One,\"a, \"\"b\"\"\nc\",\"12,5\",da\n\nP1,Again,x,nope,maybe\nP2,Two,x,inf,1\nP3,Three,x,-1,1\n,No,x,1,1\nP4,,x,1,1\nP5,Five,,1,1\nP6,Six,x,\"1.234,56\",\nP7,Seven,x,1 000,n\nP8,Eight,x,2,perhaps\n",
    )
    products, rejects, report = catalog_csv.load(spark, path)
    got = {r["product_id"]: r for r in products.collect()}
    assert set(got) == {"P1", "P7"}
    assert got["P1"]["price_ron"] == 12.5 and got["P1"]["description"] == 'a, "b"\nc' and got["P1"]["in_stock"] and not got["P7"]["in_stock"] and got["P7"]["price_ron"] == 1000
    errors = {r["line_number"]: r["error"] for r in rejects.collect()}
    assert errors == {
        2: "price_ron is invalid", 4: "duplicate product_id", 5: "price_ron is invalid", 6: "price_ron is invalid", 7: "product_id is empty",
        8: "title is empty", 9: "description is empty", 10: "price_ron is invalid", 12: "in_stock is invalid",
    }
    assert report == {"rows_read": 11, "rows_valid": 2, "rows_invalid": 9, "duplicate_ids": 1}
    with pytest.raises(ValueError, match="line 2"):
        catalog_csv.load(spark, path, strict=True)


def test_missing_columns_and_no_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="description"):
        catalog_csv.read_catalog(spark, write(tmp_path / "a.csv", "product_id,title\nP1,x\n"))
    with pytest.raises(ValueError, match="no valid"):
        catalog_csv.load(spark, write(tmp_path / "b.csv", "product_id,title,description\n,,\n,x,y\n"))


def test_semantic_text_leaves_out_what_is_missing(spark):
    row = spark.createDataFrame([("T", "D", None, "B", None, "P", 3.0)], "title string, description string, category string, brand string, color string, audience string, price_ron double")
    assert row.select(catalog_csv.semantic_text().alias("t")).first()["t"] == "Titlu: T. Descriere: D. Brand: B. Public: P."


def test_queries_skip_blanks(spark, tmp_path):
    assert [r["query"] for r in catalog_csv.read_queries(spark, write(tmp_path / "q.csv", "query\none\n  \ntwo\n")).collect()] == ["one", "two"]


def test_files(spark, tmp_path):
    path = f"{tmp_path}/x/y.json"
    assert not files.exists(spark, path)
    for value in ({"a": 1}, {"a": "ă"}):
        files.write_json(spark, path, value)
        assert files.read_json(spark, path) == value


def test_checksum_ignores_order_but_not_rows(spark):
    a = spark.range(100)
    assert files.table_checksum(a) == files.table_checksum(a.repartition(7)) != files.table_checksum(spark.range(101))


def test_generator(spark, tmp_path):
    made = generator.products(spark, 512).cache()
    rows = {r["product_id"]: r for r in made.collect()}
    assert len(rows) == 512 and rows["P0000001"]["category_id"] == 1 and rows["P0000512"]["category_id"] == 256
    check = generator.constraint_checks(made, generator.categories(spark)).first().asDict()
    assert check == {"products": 512, "bad_prices": 0, "bad_stock": 0, "repeated_ids": 0, "orphans": 0, "categories": 256, "smallest": 2, "largest": 2}
    assert made.exceptAll(generator.products(spark, 512)).count() == 0
    assert generator.products(spark, 20, category_count=5).select("category").distinct().count() == 5
    with pytest.raises(ValueError):
        generator.products(spark, 5, category_count=257)
    path = f"{tmp_path}/copy"
    generator.write_catalog(made, path)
    with pytest.raises(Exception, match="exists"):
        generator.write_catalog(made, path)
    assert catalog_csv.load(spark, path)[2]["rows_valid"] == 512


def test_sqlite_copy(spark, tmp_path):
    path = f"{tmp_path}/p.sqlite"
    made = generator.products(spark, 300)
    assert generator.write_sqlite(made, generator.categories(spark), path, batch=100) == 300
    with pytest.raises(FileExistsError):
        generator.write_sqlite(made, generator.categories(spark), path)
    assert generator.write_sqlite(made, generator.categories(spark), path, force=True) == 300
