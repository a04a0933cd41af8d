import re
import zlib

import numpy as np
import pytest

from tessera.llm import language_model as lm
from tessera.llm.queries import op8_language_model


def check(found, rows):
    got = {r["doc_id"]: r for r in found}
    for i, (held, size, known, total, base) in lm.reference_base(rows).items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, size, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0 and np.isfinite(r["score"])


def test_odd_rows(make, clashing, odd_rows):
    rows = [(100 + k, t) for k, (_, t) in enumerate(odd_rows)]
    check(lm.language_scores(clashing(make(rows), "kind", "held_out", "c", "n")).collect(), rows)
    assert lm.language_scores(make([])).count() == 0


def test_repeated_and_null_ids(make):
    got = lm.language_scores(make([(1, "a b"), (1, "a b"), (None, "a")])).collect()
    assert len(got) == 3 and all(not r["held_out"] for r in got if r["doc_id"] is None) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_nothing_to_learn_from(make):
    held = next(i for i in range(100) if lm.reference_base([(i, "x")])[i][0])
    (r,) = lm.language_scores(make([(held, "some words here")])).collect()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0) and r["score"] < 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    logs = lm.class_chances(rng.standard_normal((lm.FEATURES, lm.CLASSES)), np.arange(lm.CONTEXTS), lm.feature_places())
    assert np.allclose(np.exp(logs).sum(axis=1), 1)


def test_class_training_climbs(spark):
    rng = np.random.default_rng(2)
    cells = {}
    for c in rng.integers(0, lm.CONTEXTS, 4000).tolist():
        key = c * lm.CLASSES + (c // lm.CLASSES + c) % 5
        cells[key] = cells.get(key, 0) + 1
    table = spark.createDataFrame(list(cells.items()), "cell int, n long")
    _, history = lm.train_classes(table, 8)
    assert history == sorted(history) and history[-1] > history[0] + 0.5


def test_word_training_climbs_and_normalises(spark):
    rng = np.random.default_rng(3)
    mass = np.zeros((lm.CLASSES, lm.BUCKETS))
    mass[1:3, :40] = 0.99 / 40
    cells, pairs = np.zeros(lm.CELLS), np.zeros(lm.CLASSES * lm.BUCKETS)
    for _ in range(3000):
        last, before, kind = int(rng.integers(lm.LAST)), int(rng.integers(lm.CLASSES)), int(rng.integers(1, 3))
        token = last % 5 + 5 * (before % 3)  # depends on both features
        context = np.array([last * lm.CLASSES + before])
        cells[context[0] * lm.CLASSES + kind] += 1
        for place in lm.pair_places(np.array([token], np.uint64), np.array([kind]), context):
            pairs[place] += 1
    _, _, history = lm.train_words(spark, cells, pairs, mass, 8)
    assert history == sorted(history) and abs(history[0]) < 1e-9 and history[-1] > 0.1
    w = rng.standard_normal(lm.BUCKETS)
    z, expected = lm.normaliser(w, mass[1], np.ones((lm.NEAR, lm.CLASSES)))
    one = [[1 - mass[1].sum() + sum(mass[1][b] * np.exp(w[lm._KEYS[x] ^ b] + w[lm._KEYS[lm.NEAR + y] ^ b]) for b in range(40)) for y in range(3)] for x in range(3)]
    assert np.allclose(z[:3, :3], one)
    assert expected.sum() == pytest.approx(2 * (1 - (1 - mass[1].sum()) / z).sum())


def brute_score(model, ids, texts):
    """doc_id -> score, word by word: every token's probability from its features, and the normaliser over all words of its class."""
    from collections import Counter
    from math import exp, log10

    word = lambda t: lm.textkit.words_of(*lm.textkit.buffers(lm.pa.array([t])), lm.textkit.space_words())
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in zip(ids, texts, strict=True)}
    counts = Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    every = set().union(*split.values())
    hashes = {w: int(word(w).hashes()[0]) for w in every}
    kinds = {w: int(lm.classes_of(word(w))[0]) for w in every}
    sizes = [sum(c + lm.ALPHA for w, c in counts.items() if kinds[w] == k) + lm.ALPHA for k in range(lm.CLASSES)]

    def weight(w, last, before):
        if not counts[w]:
            return 0.0
        bucket, base = hashes[w] % lm.BUCKETS, kinds[w] * lm.BUCKETS
        x = int(lm.textkit.mix(np.array([last], np.uint64))[0] % lm.LAST) % lm.NEAR
        return float(model.words[base + (int(lm._KEYS[x]) ^ bucket)]) + float(model.words[base + (int(lm._KEYS[lm.NEAR + before]) ^ bucket)])

    out = {}
    for i, ws in split.items():
        total, last, before, now = 0.0, int(lm._START), 0, 0
        for w in [*ws, None]:
            context = int(lm.textkit.mix(np.array([last], np.uint64))[0] % lm.LAST) * lm.CLASSES + before
            kind = 0 if w is None else kinds[w]
            total += float(model.classes[context, kind])
            if w is not None:
                tilted = sum((counts[v] + lm.ALPHA) / sizes[kind] * 10 ** weight(v, last, before) for v in counts if kinds[v] == kind) + lm.ALPHA / sizes[kind]
                total += log10((counts[w] + lm.ALPHA) / sizes[kind]) + weight(w, last, before) - log10(tilted)
                last, before, now = hashes[w], now, kind
        out[i] = total
    return out


def test_scores_against_word_by_word(spark, make):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("en", "ing", "s", "tion", "X")]
    texts = [" ".join(words[int(k)] for k in np.minimum(rng.geometric(0.1, 12), 39)) for _ in range(40)] + ["", "unseen terms here", None]
    ids = list(range(1, len(texts) + 1))
    docs = lm.materialise(make(list(zip(ids, texts, strict=True))).select("doc_id", "text"), "t")
    rows = lm._rows(docs)
    totals = lm.materialise(lm.word_totals(lm.partition_words(rows)), "t")
    ends = rows.where("not held_out").count()
    model = lm.trained(rows, totals, ends)
    assert np.abs(model.words).max() > 0.01
    folder = lm.scratch(spark, "t")
    lm.write_lookups(totals, folder, rows.rdd.getNumPartitions())
    got = {r["doc_id"]: r["score"] for r in lm.score(rows, folder, model).collect()}
    want = brute_score(model, ids, texts)
    for i in ids:
        assert got[i] == pytest.approx(want[i], abs=1e-4), i


def test_query_against_brute_force_and_better_than_the_base(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = op8_language_model(spark, small).collect()
    assert len(found) == len(rows)
    check(found, rows)
    assert sum(r["score"] for r in found if r["held_out"]) > sum(r["base_score"] for r in found if r["held_out"])
