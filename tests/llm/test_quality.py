import numpy as np

from tessera.llm import quality
from tessera.llm.queries import op6_quality
from tests.llm.conftest import LONG


def test_statistics_against_plain_python(make):
    import pyarrow as pa

    from tessera.llm import textkit

    texts = ["The THE cat !! a a a", "", "x\nx\ny", "é è ç de la"]
    (lo, hi, data, offsets) = next(textkit.slices(pa.array(texts)))
    s = quality.Slice(data, offsets)
    got = {k: s.values[:, i] for i, k in enumerate(quality.STATISTICS)}
    assert s.counts.tolist() == [7, 0, 3, 5]
    assert np.allclose(got["repeats"], [3 / 7, 0, 1 / 3, 0])
    assert np.allclose(got["variety"], [4 / 7, 0, 2 / 3, 1])
    assert np.allclose(got["top"], [3 / 7, 0, 2 / 3, 1 / 5])
    assert np.allclose(got["upper"], [4 / 12, 0, 0, 0]) and np.allclose(got["symbols"][0], 2 / len(texts[0]))
    assert np.allclose(got["lines"], [0, 0, 1 / 3, 0]) and got["common"][3] == 2 / 5


def test_odd_rows(make, clashing, odd_rows):
    docs = clashing(make(odd_rows), "score", "kept", "n_words")
    got = quality.judged(docs).collect()
    assert len(got) == len(odd_rows)
    assert all(not r["kept"] for r in got if r["n_words"] == 0)
    assert {r["n_words"] for r in got if r["doc_id"] == 4} == {len(LONG.split())}
    assert quality.good_documents(docs).columns == docs.columns
    assert quality.judged(make([])).count() == 0


def test_labels_of_the_driver(spark):
    """The model never sees a label; they only measure it."""
    from tests.conftest import DATA

    found = op6_quality(spark, f"{DATA}/sf0.1").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").toPandas()
    clean, junk = found[found.quality == 1], found[found.quality == 0]
    assert clean.kept.mean() > 0.998 and (~junk.kept).mean() > 0.95


def test_the_scorer_learns():
    rng = np.random.default_rng(1)
    rows = [([int(x)], [1.0], float(x < 5)) for x in rng.integers(0, 10, 400)]
    w = quality.train_scorer(rows)
    assert (w[:5] + w[-1] > 0).all() and (w[5:10] + w[-1] < 0).all()
    assert not quality.train_scorer([]).any()


def test_repeated_and_null_ids_and_equal_rows(make):
    good = "The cat and the dog went to the old house of my friend, and then they ate what was there. "
    rows = [(None if i % 2 else 1, f"{good} It is the {i}th story of this town and its people." if i % 3 else "!!! $$$ ### " * 20 + str(i)) for i in range(300)]
    got = quality.judged(make(rows)).collect()
    assert len(got) == 300 and len({r["score"] for r in got}) > 1
    assert len(quality.judged(make(rows), train_rows=20).collect()) == 300
    alike = quality.judged(make([(1, good)] * 200), train_rows=10).collect()
    assert len(alike) == 200 and len({r["score"] for r in alike}) == 1
    weights, _ = quality.fit(make([(1, good)] * 200), 1)
    assert weights.any()


def test_query_against_brute_force(spark, small):
    """Votes, labels and scores again, text by text."""
    from tessera.llm.weak_labels import reliabilities

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    weights, post = quality.fit(docs.select("doc_id", "text"))
    votes = {i: "".join(map(str, votes_of(t))) for i, t in texts.items()}
    counts = {}
    for v in votes.values():
        counts[v] = counts.get(v, 0.0) + 1
    want = reliabilities(counts, [(0, 1)] * len(quality.LABELERS), silence=False)[0]
    assert post.keys() == want.keys() and all(abs(post[v] - want[v]) < 1e-9 for v in want)
    for r in op6_quality(spark, small).collect():
        text = texts[r["doc_id"]]
        assert r["votes"] == votes[r["doc_id"]] and r["weak_label"] == post[r["votes"]]
        z = float(weights[-1])
        part = one(text)
        _, bucket, weight = part.features()
        for b, w in zip(bucket.tolist(), weight.tolist(), strict=True):
            z += float(weights[b]) * w
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["n_words"] == len(words_of(text)) and r["kept"] == (r["score"] >= quality.THRESHOLD and r["n_words"] > 0)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def one(text):
    import pyarrow as pa

    from tessera.llm import textkit

    _, _, data, offsets = next(textkit.slices(pa.array([text or ""])))
    return quality.Slice(data, offsets)


def votes_of(text):
    """Each labeler's vote from its statistic and thresholds, one by one."""
    values, n = one(text).values[0], len(words_of(text))
    out = []
    for x, (_, bad, good, least) in zip(values, quality.LABELERS, strict=True):
        worse, better = (x > bad, x < good) if bad > good else (x < bad, x > good)
        out.append(2 if n < least else 1 if better else 0 if worse else 2)
    return out
