import random

import numpy as np
import pytest

from tessera.llm import decontamination as d
from tessera.llm.queries import op4_decontamination

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it runs away home"), (2, "of the"), (3, "It IS"), (None, "zzz qqq"), (4, None), (5, "--"), (1, "another text"), (6, "fox jumps over the lazy dog and then it runs away home again")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def check(found, rows, items=ITEMS):
    got = {r["doc_id"]: tuple(r)[1:] for r in d.digest(found).collect()}
    for i, t in rows:
        assert got[i] == d.reference_digest(t, items), t


ROWS = [
    (10, ITEMS[0][1]), (11, "x " + ITEMS[0][1].upper() + "! y " + ITEMS[0][1]), (12, "quick brown fox"), (13, "of of the the of, the"), (14, "zzz-qqq zzz\nqqq"), (15, "the quick brown fox jumps over the lazy dog AND"), (16, "é of é the"),
    (17, "it is it is of the it"), (18, " ".join([ITEMS[7][1]] * 400)),
]


@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 60])
def test_against_brute_force(make, items, clashing, odd_rows, block):
    rows = ROWS + [(100 + k, t) for k, (_, t) in enumerate(odd_rows)]
    check(d.overlaps(clashing(make(rows), "items", "cuts"), items, block_bytes=block), rows)


def test_random_texts(make, spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(n))
    items = [(i, words(rng.randint(1, 14))) for i in range(12)]
    rows = [(i, words(rng.randint(0, 120))) for i in range(60)]
    check(d.overlaps(make(rows), spark.createDataFrame(items, "item_id long, text string")), rows, items)


def test_long_items_are_cut_into_pieces_with_the_same_windows(make, spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randint(0, 40)}" for _ in range(900)) + " é"
    items = [(1, long), (2, "w1 w2 w3"), (None, long[:400])]
    table = spark.createDataFrame(items, "item_id long, text string")
    cut = d.pieces(table, 10, 200).collect()
    assert len(cut) > 15 and max(len((r["text"] or "").encode()) for r in cut) <= 200
    words = long.split()
    rows = [(i, " ".join([*(f"x{k}" for k in range(i % 3)), *words[(i * 37) % 880 :][: 8 + i % 30]])) for i in range(60)]
    check(d.overlaps(make(rows), table, block_bytes=1000), rows, items)


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_regular_words_are_told_apart(make, spark, letters):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(letters))
    other = one.translate(str.maketrans("ab", "ba"))
    items = [(1, f"this is {one}")]
    rows = [(1, f"this is {other}"), (2, f"so this is {one}")]
    check(d.overlaps(make(rows), spark.createDataFrame(items, "item_id long, text string")), rows, items)


def test_index_finds_every_place():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in rng.integers(1, 30, 40)])
    index = d.FMIndex(text)
    for _ in range(50):
        n = int(rng.integers(1, 5))
        pattern = rng.integers(1, 4, n).astype(np.int32)
        words = np.zeros((1, 6), np.int32)
        words[0, 6 - n :] = pattern
        lo, hi = index.search(words, np.array([n]))
        got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert got == [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]


def test_wavelet_ranks():
    values = np.random.default_rng(2).integers(0, 11, 300)
    matrix = d.WaveletMatrix(values, 10)
    at = np.arange(301)
    for s in range(11):
        assert (matrix.rank(np.full(301, s), at) == np.concatenate([[0], np.cumsum(values == s)])).all()
    assert (matrix.get(np.arange(300)) == values).all()


def test_cutting(make, items, clashing):
    docs = clashing(make([*ROWS, (1, None), (2, "")]))
    got = {r["doc_id"]: r for r in d.clean_documents(docs, items).collect()}
    assert got[12]["text"] == "quick brown fox" and got[1]["text"] is None and got[2]["text"] == ""
    assert got[10]["text"] == "" and got[11]["text"] == "x ! y " and got[11]["n_chars"] == 6 and got[16]["text"] == "é of é the"
    assert d.clean_documents(docs, items).columns == docs.columns


def test_nothing_to_look_for(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.digest(d.overlaps(make(ROWS), none)).where("contaminated").count() == 0
    assert d.overlaps(make([]), none).count() == 0


def test_query_against_brute_force(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in op4_decontamination(spark, small).collect()}
    assert got == {i: d.reference_digest(t, items) for i, t in rows}
