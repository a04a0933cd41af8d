import numpy as np
import pytest

from tessera.operators.router import RouterConfig
from tessera.plans import benchmark, capacity, cli, interactive
from tessera.plans.catalog import EVALUATION_FIELDS, Catalog, Filters, format_results, page, result_json
from tessera.plans.http_api import Api
from tessera.sources import generator
from tessera.streaming.build import build_streaming

CONFIG = RouterConfig(shards=4, bands=(1, 2), probe_shards=2)


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "products.csv")
    frame = generator.products(spark, 60, category_count=6).drop("category_id").toPandas()
    frame["in_stock"] = frame["in_stock"].astype(int)
    frame.to_csv(path, index=False)
    return path


@pytest.fixture(scope="module")
def catalog(spark, csv, tmp_path_factory):
    return Catalog.build(spark, csv, str(tmp_path_factory.mktemp("catalog")), config=CONFIG, dimension=48)


def ids(outcome):
    return [r["id"] for r in outcome.results.orderBy("query_id", "rank").collect()]


def test_all_shards_give_the_exact_result(catalog):
    outcome = catalog.search_text("uz zilnic baterie", top_k=7, probe_shards=4, evaluate=True)
    row = outcome.evidence.first()
    assert row["recall"] == row["precision"] == 1.0 and row["vectors_certified"]
    vectors = {r["id"]: np.array(r["vector"]) for r in catalog.vectors().collect()}
    q = catalog.provider.encode_query("uz zilnic baterie")
    assert ids(outcome) == sorted(vectors, key=lambda i: (-round(float(vectors[i] @ q), 6), i))[:7]


def test_certified_means_equal_to_everywhere(catalog):
    texts = [f"Telefonie {x} Vox" for x in generator.RANGES[:6]]
    some, everywhere = catalog.search_text(texts, top_k=3), catalog.search_text(texts, top_k=3, probe_shards=4)
    sure = {r["query_id"] for r in some.evidence.collect() if r["vectors_certified"]}
    of = lambda outcome, q: [r["id"] for r in outcome.results.where(f"query_id = {q}").orderBy("rank").collect()]
    assert all(of(some, q) == of(everywhere, q) for q in sure)


def test_load(spark, catalog):
    again = Catalog.load(spark, catalog.path)
    assert ids(again.search_text("birou")) == ids(catalog.search_text("birou"))
    assert again.stats()["products"] == 60


def test_pre_and_post_are_the_same(catalog):
    filters = Filters(price_max=400, color="NEGRU", in_stock_only=True)
    pre = catalog.search_text("sport", top_k=3, probe_shards=4, filters=filters)
    post = catalog.search_text("sport", top_k=3, probe_shards=4, filters=filters, strategy="post")
    rows = pre.results.collect()
    assert ids(pre) == ids(post) and all(r["color"] == "negru" and r["in_stock"] and r["price_ron"] <= 400 for r in rows)
    assert post.evidence.first()["budget_rounds"] >= 1


def test_all_results(catalog):
    category = catalog.products().first()["category"]
    outcome = catalog.search_text("ceva", all_results=True, filters=Filters(category=category.upper()))
    rows = outcome.results.orderBy("rank").collect()
    assert len(rows) == 10 and {r["category"] for r in rows} == {category}
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert outcome.evidence.first()["recall"] is None
    assert [r["rank"] for r in page(outcome.results, 2, 4).orderBy("rank").collect()] == [5, 6, 7, 8]


def test_vector_is_not_changed(catalog):
    v = catalog.provider.encode_query("casă") * 3
    before = v.copy()
    assert ids(catalog.search_vector(v)) == ids(catalog.search_text("casă")) and (v == before).all()


def test_errors(catalog):
    for call in (lambda: catalog.search_text(" "), lambda: catalog.search_text("x", top_k=0), lambda: catalog.search_text("x", strategy="never"), lambda: catalog.search_vector([0.0] * 48), lambda: catalog.search_text("x", probe_shards=9)):
        with pytest.raises(ValueError):
            call()


def test_unknown_radius_never_certifies(catalog):
    changed = Catalog(catalog.spark, catalog.path, catalog.provider, catalog.router.updated(0, catalog.router.centroids[0]), catalog.manifest)
    for r in changed.search_text([f"text {i}" for i in range(6)], top_k=2, probe_shards=1).evidence.collect():
        assert 0 in r["shard_ids"] or not r["vectors_certified"]


def test_embeddings_are_kept(spark, csv, catalog):
    again = Catalog.build(spark, csv, catalog.path, config=CONFIG, dimension=48)
    assert again.manifest["embeddings_cached"] and not Catalog.build(spark, csv, catalog.path, config=CONFIG, dimension=48, force_embeddings=True).manifest["embeddings_cached"]


def test_streaming_build_of_one_dirty_file(spark, tmp_path):
    from tessera.sources import files
    from tessera.streaming import build

    lines = ["\ufeffproduct_id,title,description,price_ron,in_stock"]
    for i in range(40):
        lines.append(f'P{i},"Titlu ""{i}""","prima linie\na doua, {i}",{i}.5,da')
    lines += ["", "P3,Again,Copy,1,da", ",No id,x,1,da", "P50,Bad price,x,abc,da", "P51,Bad stock,x,1,maybe", "P4,Bad and again,x,abc,da", "P52,Last,x,,"]
    path = tmp_path / "one.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    out = str(tmp_path / "s")
    streamed = build_streaming(spark, str(path), out, config=CONFIG, dimension=24, part_bytes=300, files_a_batch=2)
    assert len(list((tmp_path / "s" / "input").glob("file-*.csv"))) > 5
    whole = Catalog.build(spark, str(path), str(tmp_path / "w"), config=CONFIG, dimension=24)
    same = ["product_id", "title", "description", "price_ron", "in_stock"]
    assert streamed.products().select(same).exceptAll(whole.products().select(same)).count() == 0 and streamed.products().count() == 41
    bad = lambda p: sorted((r["product_id"] or "", r["error"]) for r in spark.read.parquet(f"{p}/rejects").collect())
    assert bad(out) == bad(tmp_path / "w")
    counts = files.read_json(spark, f"{out}/import_report.json")
    assert (counts["rows_read"], counts["rows_valid"], counts["rows_invalid"], counts["duplicate_ids"]) == (46, 41, 5, 2)
    assert files.exists(spark, f"{out}/router.json") and spark.read.json(f"{out}/semantic_texts").count() == 41
    path.write_text("\n".join(lines[:3]), encoding="utf-8")
    with pytest.raises(ValueError):
        build_streaming(spark, str(path), out, config=CONFIG, dimension=24)
    assert list(build.records(iter([b'a,"x\ny"', b"\n", b"\n b,1\nc"]))) == [b'a,"x\ny"\n', b" b,1\n", b"c"]


def test_approximate_local_index(catalog):
    exact, rough = (catalog.search_text("uz zilnic baterie", top_k=5, probe_shards=4, local_index=x) for x in ("exact", "lsh"))
    assert set(ids(rough)) and rough.evidence.first()["local_index"] == "lsh" and not rough.evidence.first()["vectors_certified"]
    assert exact.evidence.first()["local_index"] == "exact" and len(set(ids(rough)) & set(ids(exact))) >= 3


def test_stored_local_index(spark, csv, tmp_path):
    from tessera.operators import local_index

    catalog = Catalog.build(spark, csv, str(tmp_path / "c"), config=CONFIG, dimension=48, local_index="hnsw")
    assert catalog.manifest["stored_index"]["entries"] == catalog.index_rows().count() == 60 * 8
    again = Catalog.load(spark, catalog.path)
    outcome = again.search_text("uz zilnic baterie", top_k=5, probe_shards=4, filters=Filters(price_min=0))
    assert outcome.evidence.first()["local_index"] == "lsh" and ids(outcome)
    q = catalog.queries(["uz zilnic baterie"])
    routes = spark.createDataFrame([(0, s) for s in range(4)], "query_id long, shard_id int")
    numbers = catalog.manifest["stored_index"]
    stored = local_index.stored_topk(catalog.index_rows(), numbers, catalog.vectors(), q, 5, routes)
    fresh = local_index.lsh_topk(catalog.vectors(), q, 5, routes=routes)
    assert [tuple(r) for r in stored.orderBy("rank").collect()] == [tuple(r) for r in fresh.orderBy("rank").collect()]


def test_streaming_build_holds_the_same_products(spark, csv, catalog, tmp_path):
    streamed = build_streaming(spark, csv, str(tmp_path / "s"), config=CONFIG, dimension=48)
    assert streamed.vectors().count() == 60 and streamed.vectors().select("shard_id").distinct().count() == 4
    a, b = (ids(c.search_text("grădină", top_k=8, probe_shards=4)) for c in (streamed, catalog))
    assert a == b


def test_reports(spark, catalog, tmp_path):
    outcome = catalog.search_text("școală", top_k=2, evaluate=True)
    for _ in range(2):
        catalog.log_evaluation(outcome, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and tuple(log.columns) == EVALUATION_FIELDS and len(EVALUATION_FIELDS) == 15
    row = log.first()
    assert row["query"] == "școală" and row["recall_at_k"] is not None and row["result_product_ids"].startswith('["') and row["oracle_product_ids"].startswith('["')
    catalog.log_evaluation(catalog.search_text("birou"), str(tmp_path / "log.csv"))
    assert spark.read.csv(str(tmp_path / "log.csv"), header=True, escape='"').first()["filter_strategy"] == "pre"
    assert "product" not in format_results(outcome) and "RON" in format_results(outcome)
    assert '"score"' in result_json(outcome.results).first()["json"]
    queries = spark.createDataFrame([(0, "sport"), (1, "birou")], "query_id long, query string")
    report = benchmark.catalog_benchmark(catalog, queries, (1, 4), 3)
    assert report["by_probe"][4]["recall"] == 1.0
    benchmark.write_report(spark, report, str(tmp_path / "r"))


def test_synthetic_benchmark():
    report = benchmark.synthetic(64, 16, 10, 4, (2, 4), 8)
    assert report["methods"]["exhaustive"]["recall"] == 1.0 == report["methods"]["router"]["recall"]
    assert benchmark.smooth_centroids(32, 8).shape == (32, 8)


def test_session(catalog):
    lines = iter(["/top 2", "/culoare negru", "sport", "/culoare -", "/pagina 5", "/toate", "birou", "q", "/pret-min x", "/sharduri 99", "/sharduri toate", "/stoc da", "/fara-filtre", "/nimic", "/iesire", "nu se citește"])
    out = []
    assert interactive.run(catalog, read=lambda prompt: next(lines), write=out.append) == 2
    assert out[-1] == "La revedere." and any("Comandă necunoscută" in x for x in out) and any("60 rezultate" in x for x in out)


def test_http(catalog, spark):
    assert Api(spark).handle("POST", "/search", {"text": "x"})[0] == 409
    api = Api(spark, catalog)
    assert api.handle("GET", "/health", {})[1]["loaded"] and api.handle("GET", "/router/stats", {})[0] == 200
    status, answer = api.handle("POST", "/search", {"text": "birou", "top_k": 2, "filters": {"in_stock_only": True}})
    assert status == 200 and len(answer["results"]) == 2
    for body in ({}, {"text": "a", "vector": [1.0]}, {"text": "a", "filters": {"nothing": 1}}):
        assert api.handle("POST", "/search", body)[0] == 422
    assert api.handle("GET", "/nowhere", {})[0] == 404


def test_command_line(spark, csv, tmp_path, capsys):
    index = str(tmp_path / "index")
    assert cli.main(["build", "--csv", csv, "--output", index, "--shards", "3", "--bands", "1", "--probe-shards", "2", "--embedding-dimension", "32"], spark) == 0
    assert cli.main(["search", "--index", index, "--query", "sport", "--top-k", "2", "--json", "--evaluate"], spark) == 0
    assert '"results"' in capsys.readouterr().out


def test_command_line_of_a_streaming_build(spark, csv, tmp_path, capsys):
    index, batch = str(tmp_path / "index"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    options = ["--local-index", "hnsw", "--kmeans-epochs", "3", "--progress-every", "20", "--batch-size", "500", "--embedding-batch-size", "8", "--streaming"]
    try:
        assert cli.main(["build", "--csv", csv, "--output", index, "--shards", "3", "--bands", "1", "--probe-shards", "3", "--embedding-dimension", "32", *options], spark) == 0
        assert "60 records" in capsys.readouterr().out
        assert cli.main(["search", "--index", index, "--query", "sport", "--top-k", "2", "--json", "--report", str(tmp_path / "log.csv")], spark) == 0
        assert '"local_index": "lsh"' in capsys.readouterr().out
        assert cli.main(["search", "--index", index, "--query", "sport", "--top-k", "2", "--json", "--local-index", "exact"], spark) == 0
        assert '"local_index": "exact"' in capsys.readouterr().out
        assert spark.read.csv(str(tmp_path / "log.csv"), header=True).count() == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_capacity(spark):
    row = capacity.estimate(router_ms=0.3, local_p95_ms=8.0, network_p95_ms=1.5, merge_ms=1.0)
    assert row["total_ms"] == pytest.approx(10.8) and not row["physical"] and row["items_per_shard"] == pytest.approx(61035.15625)
    assert capacity.estimate()["total_ms"] is None
    for bad in ({"items": 0}, {"probe_shards": 99, "shards": 9}):
        with pytest.raises(ValueError):
            capacity.estimate(**bad)
    assert capacity.estimate_table(spark, {}, {"shards": 64, "probe_shards": 4}).count() == 2
