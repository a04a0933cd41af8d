import random

import numpy as np
import pytest

from tessera.llm import near_duplicates as n
from tessera.llm.components import connected_components
from tessera.llm.queries import op5_near_duplicates


def family(rng, copies, edits, words=80, start=0):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append((start + i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = family(rng, 90, 4) + family(rng, 30, 2, 40, 200) + family(rng, 12, 1, 300, 300)
    out += [(400 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(40)]
    return out + [(500 + i, out[0][1]) for i in range(25)]


@pytest.mark.parametrize(("tile", "hubs"), [(512, n.HUBS), (16, n.HUBS), (16, 1)])
def test_components(make, clashing, odd_rows, rows, tile, hubs):
    extra = [(600 + k, t) for k, (_, t) in enumerate(odd_rows)] + [(700, "a b c d e"), (701, "A b C d e"), (702, "a b c d"), (703, "a b c d e f")]
    docs = clashing(make(rows + extra), "sub_keys", "n_shingles", "tiles", "own")
    got = {r["doc_id"]: r for r in n.near_duplicates(docs, tile=tile, hubs=hubs).collect()}
    want = n.reference_components(rows + extra)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


@pytest.mark.parametrize("letters", [1024, 2048])
def test_regular_words_are_told_apart(make, letters):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(letters))
    texts = [(1, f"a b c d {one}"), (2, f"a b c d {one.translate(str.maketrans('ab', 'ba'))}"), (3, f"A b c d {one}")]
    assert {r["doc_id"]: r["component_id"] for r in n.near_duplicates(make(texts)).collect()} == {1: 1, 2: 2, 3: 1}


def test_members_further_than_the_hub_allows(make):
    """A chain whose ends are far apart, and a hub that is near to none of two alike."""
    words = [f"w{i}" for i in range(200)]
    edit = lambda places: " ".join("x" + w if k in places else w for k, w in enumerate(words))
    chain = [(1 + k, edit(set(range(3 * k, 3 * k + 3)))) for k in range(8)]
    far = [(0, edit(set(range(0, 200, 40))))]
    rows = [*far, *chain, (50, edit({60, 100, 140})), (51, edit({60, 100, 140, 141}))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.near_duplicates(make(rows)).collect()}
    assert got == n.reference_components(rows)


def test_a_large_family_moves_in_proportion(make, spark):
    """Texts that go to a verifying task: a few a document, however large the family."""
    rng = random.Random(4)
    counts = {}
    for size in (300, 1200):
        docs = make(random.Random(1).sample(family(rng, size, 1, 120), size))
        classes = n.sketches(docs).where("n_shingles > 0").select(n.F.col("doc_id").alias("id"), "sub_keys")
        found = n.buckets(classes)
        texts = docs.select(n.F.col("doc_id").alias("id"), "text")
        links, doubts = n.hub_links(found, texts, n.SHINGLE, n.LEAST, 64, n.HUBS)
        components = n.connected_components(links)
        members = n.families(components, doubts)
        moved = links.count() + (n.tiled(members, 64).count() if members is not None else 0)
        counts[size] = moved / size
    assert counts[1200] < 1.5 * counts[300] < 6


def test_repeated_ids_and_null_ids(make):
    docs = make([(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "q r s t u v"), (3, None), (3, None)])
    got = [tuple(r) for r in n.near_duplicates(docs).collect()]
    assert sorted((i, c, k) for i, _, c, k in got if i) == [(1, 1, True)] * 3 + [(2, 1, False)] + [(3, 3, True)] * 2
    assert [(c, k) for i, _, c, k in got if i is None] == [(None, True)]
    kept = n.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert rows == [(0, "q r s t u v"), (1, "a b c d e f"), (1, "q r s t u v"), (3, ""), (3, "")]
    alone = make([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (4, None), (5, None), (None, "a b c d e f")])
    assert sorted(r["doc_id"] or 0 for r in n.deduplicated(alone).collect()) == [0, 1, 3, 4, 5]


def test_empty(make):
    assert n.near_duplicates(make([])).count() == 0
    assert n.deduplicated(make([])).count() == 0


def test_borderline_similarity_is_exact():
    sets = [np.arange(100, dtype=np.uint64), np.arange(8, 108, dtype=np.uint64), np.arange(9, 109, dtype=np.uint64)]
    links = n.similar(sets, np.arange(3), np.arange(3))
    assert links[0, 1] and not links[0, 2]  # 92 / 108 and 91 / 109


def test_tables_meet_at_the_promised_rate():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 230, dtype=np.uint64)
        a, b = np.sort(pool[:215]), np.sort(pool[15:])  # 200 of 230
        keys = n.sub_keys(np.concatenate([a, b]), np.array([0, 215, 430]))
        same = keys[0] == keys[1]
        met += same[: n.SUBKEYS].any() and same[n.SUBKEYS :].any()
    assert met >= 299


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(4, 4)], []])
def test_connected_components(spark, edges):
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            low = min(want.get(a, a), want.get(b, b))
            old = {want.get(a, a), want.get(b, b)}
            want[a] = want[b] = low
            want = {k: low if v in old else v for k, v in want.items()}
    assert got == want


def test_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_near_duplicates(spark, small).collect()}
    assert got == n.reference_components(rows)


def test_the_stage_takes_a_similarity_of_four_fifths(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = n.reference_components(rows, least=(80, 100))
    assert want != n.reference_components(rows, least=(85, 100))
    assert sorted(r["doc_id"] for r in n.deduplicated(docs).collect()) == sorted(i for i, (_, c) in want.items() if i == c)
