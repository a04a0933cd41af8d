import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontamination, mixing, near_duplicates
from tessera.llm.shared import materialise, tokenizer_path


def test_stages_against_brute_force(spark, small):
    docs = corpus_pipeline.documents(spark, small)
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, small), "test")
        kept[name] = (before, docs)
        assert name == "token output" or docs.columns == columns
    before, after = kept["quality classifier"]
    assert after.exceptAll(before).count() == 0
    gone = {r["doc_id"] for r in before.select("doc_id").exceptAll(after.select("doc_id")).collect()}
    assert sum(labels.get(i) == 1 for i in gone) <= 1 and sum(labels.get(i) == 0 for i in gone) >= 0.8 * sum(v == 0 for v in labels.values())
    before, after = kept["near-duplicate removal"]
    groups = near_duplicates.reference_components([(r["doc_id"], r["text"]) for r in before.collect()], least=near_duplicates.STAGE_LEAST)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    before, after = kept["benchmark decontamination"]
    clean = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        assert (clean[r["doc_id"]]["text"] == r["text"]) == (decontamination.reference_digest(r["text"], items)[1] == 0)
        assert clean[r["doc_id"]]["n_chars"] == len(clean[r["doc_id"]]["text"])
    before, after = kept["source mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect()}
    copies = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert copies == {i: n for i, n in plan.items() if n}
    before, after = kept["token output"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in before.collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in after.collect()) == want


def test_run_is_the_stages(spark, small):
    a, b = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_stages_on_odd_documents(spark, small, make, clashing, odd_rows):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names: no stage fails, and each keeps what it should."""
    from pyspark.sql import functions as F

    prose = spark.read.parquet(f"{small}/documents.parquet").where("n_chars between 300 and 900").orderBy("doc_id").limit(12).collect()
    rows = [*odd_rows, *[(1000 + k, r["text"], None if k % 3 else "t") for k, r in enumerate(prose)], (1000, prose[0]["text"], "t")]
    docs = clashing(make(rows)).withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = materialise(stage(spark, docs, small), "odd")
        if name != "token output":
            assert docs.columns == columns, name
        if name == "quality classifier":
            assert docs.where("trim(coalesce(text, '')) = ''").count() == 0
        if name == "near-duplicate removal":
            assert docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "benchmark decontamination":
            assert docs.count() == before
    assert docs.count() > 0


def test_stages_on_nothing(spark, small, make):
    docs = make([])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, small), "none")
        assert docs.count() == 0, name
