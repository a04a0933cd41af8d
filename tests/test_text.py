import numpy as np
import pytest

from tessera.functions import text


def test_hash_vectors_are_deterministic_and_of_unit_length():
    p = text.HashProvider(64)
    a = p.encode_texts(["Telefon mare", "cameră bună", "Telefon mare", ""])
    assert (a[0] == a[2]).all() and not (a[0] == a[1]).all()
    assert np.allclose(np.linalg.norm(a, axis=1), 1)
    assert (p.encode_texts(["CAMERĂ Bună"])[0] == a[1]).all()
    assert (p.encode_texts(["  --  "])[0] == a[3]).all()


def test_features_are_those_of_the_columns(spark):
    words = "ab abcd xyz ab"
    got = spark.createDataFrame([(words,)], "t string").select(text.ngram_features(text.tokens("t")).alias("f")).first()["f"]
    assert sorted((f["feature"], f["weight"]) for f in got) == sorted(text.HashProvider(16).features(words))
    none = spark.createDataFrame([("--",)], "t string").select(text.ngram_features(text.tokens("t")).alias("f")).first()["f"]
    assert none == []


def test_fast_hash():
    p = text.create_provider("fast-hash", 32)
    a = p.encode_texts(["one two", "two one", "", "a"])
    assert np.allclose(np.linalg.norm(a, axis=1), 1) and not (a[0] == a[1]).all()


def test_prefixes():
    seen = []

    class Model:
        def __init__(self, name):
            pass

        def get_sentence_embedding_dimension(self):
            return 2

        def encode(self, texts):
            seen.extend(texts)
            return [[3.0, 4.0]] * len(texts)

    p = text.ModelProvider("m", "passage: ", "query: ", Model)
    assert np.allclose(p.encode_texts(["x"]), [[0.6, 0.8]]) and np.allclose(p.encode_query("y"), [0.6, 0.8])
    assert seen == ["passage: x", "query: y"]


def test_remote():
    p = text.RemoteProvider("m", 2, post=lambda body: {"data": [{"embedding": [0.0, 2.0]} for _ in body["input"]]})
    assert p.encode_texts(["a", "b"]).tolist() == [[0, 1], [0, 1]]


def test_errors():
    for call in (lambda: text.HashProvider(8), lambda: text.create_provider("nothing"), lambda: text.HashProvider(16).encode_query(" ")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        text.RemoteProvider("m", 2, post=lambda body: {"data": [{"embedding": [0.0, 0.0]}]}).encode_texts(["a"])
    assert isinstance(text.create_provider("auto", 16), text.HashProvider | text.ModelProvider)


def test_words_are_hashed_once(monkeypatch):
    p = text.HashProvider(32)
    texts = ["", "one two one two one, Ștefan x", "two " * 700 + "½ ™ ﬁn a\u0301\u0327b İstanbul K", "!?"]
    want = np.zeros((len(texts), 32))
    for row, t in zip(want, texts, strict=True):
        for feature, weight in p.features(t):
            place, sign = p.place(feature)
            row[place] += sign * weight
        if not row.any():
            place, sign = p.place("empty")
            row[place] = sign
    want = want / np.linalg.norm(want, axis=1, keepdims=True)
    assert (p.encode_texts(texts) == want).all()
    for name, small in (("KEPT_CHARACTERS", 30), ("KEPT_PAIRS", 2), ("SOME_WORDS", 3)):
        monkeypatch.setattr(text, name, small)
        assert (p.encode_texts(texts) == want).all()
    monkeypatch.undo()
    seen, plain = [], p.place
    monkeypatch.setattr(p, "place", lambda feature: seen.append(feature) or plain(feature))
    monkeypatch.setattr(p, "features", None)  # no text is taken feature by feature
    p.encode_texts(["two one " * 50] * 3)
    assert len(seen) == len(set(seen))


def test_fold_drops_every_combining_mark():
    import sys
    import unicodedata

    for c in map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1, 7)]):
        assert text.fold(c) == "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))


def test_only_different_words_are_cut_into_grams(spark, monkeypatch):
    from collections import Counter

    from tessera.plans import catalogue

    texts = ["ab cd ab", None, "", "x", "ab cd " * 50, "it was the 2nd"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    cut, plain = [], text.ngram_features
    monkeypatch.setattr(text, "ngram_features", lambda words: cut.append(str(words)) or plain(words))
    got = {r["feature"]: (r["n"], r["weight"]) for r in catalogue._feature_counts(df).collect()}
    want, weights = Counter(), {}
    for t in texts:
        for feature, weight in text.HashProvider(16).features(t or ""):
            want[feature] += 1
            weights[feature] = weight
    assert got == {f: (n, round(n * weights[f], 6)) for f, n in want.items()}
    assert len(cut) == 1 and "substring" in cut[0]  # single counted words, not the token arrays of texts


def test_embed(spark):
    df = spark.createDataFrame([(1, "one"), (2, None), (3, "one")], "id int, t string")
    got = {r["id"]: r["embedding"] for r in text.embed(df, "t", text.HashProvider(16)).collect()}
    assert got[1] == got[3] != got[2] and len(got[2]) == 16


def test_fold(spark):
    df = spark.createDataFrame([("Ștefan ÎNGER ß",), (None,)], "t string")
    assert [r[0] for r in df.select(text.fold_column(df["t"])).collect()] == ["stefan inger ss", None]


def test_queries_over_the_documents_against_brute_force(spark, small):
    from collections import Counter

    from tessera.plans import catalogue

    p = text.HashProvider(64)
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    counts, weights = Counter(), {}
    for t in rows.values():
        for feature, weight in p.features(t):
            counts[feature] += 1
            weights[feature] = weight
    found = {r["feature"]: (r["n"], r["weight"]) for r in catalogue.queries()["document_features"](spark, small).collect()}
    assert {f: n for f, (n, _) in found.items()} == counts
    assert all(abs(w - n * weights[f]) < 1e-5 for f, (n, w) in found.items())
    got = {r["doc_id"]: r["embedding"] for r in catalogue.queries()["document_embedding"](spark, small).collect()}
    assert got.keys() == rows.keys()
    assert all(np.allclose(got[i], p.encode_texts([t])[0]) for i, t in rows.items())
