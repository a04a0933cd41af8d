"""Text normalisation, tokens, hashed features and embedding providers."""

from __future__ import annotations

import functools
import hashlib
import importlib.util
import json
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib import request

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Fixed values of the hashed embedding: weights of words, character n-grams by width, and word pairs.
WORD_WEIGHT, GRAM_WEIGHTS, PAIR_WEIGHT = 2.0, {3: 0.35, 4: 0.25, 5: 0.15}, 0.75
#: Characters of the words, and pairs (and n-grams), whose hashes HashProvider keeps; a full store is emptied. Words of a text that are added up at once.
KEPT_CHARACTERS, KEPT_PAIRS, SOME_WORDS = 1 << 20, 1 << 18, 1 << 14


@functools.cache
def _marks() -> re.Pattern:
    """Any combining mark."""
    return re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")


def fold(text: str) -> str:
    """Case-folded, decomposed, without combining marks."""
    if text.isascii():
        return text.lower()
    return _marks().sub("", unicodedata.normalize("NFKD", text.casefold()))


def fold_column(text: Column) -> Column:
    """fold() as an Arrow function: there is no NFKD among the built-in ones."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fold(x))

    return folded(text)


def tokens(text: Column) -> Column:
    """Tokens of plain lower-cased text, inside the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def ngram_features(words: Column) -> Column:
    """Array of (feature, weight) of a token array: words, character n-grams of ^word$, and pairs of neighbours."""
    pair = F.struct(F.lit("").alias("feature"), F.lit(0.0).alias("weight"))
    empty = F.filter(F.array(pair), lambda x: F.lit(False))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("^"), word, F.lit("$"))
        parts = [F.array(F.struct(F.concat(F.lit("w:"), word).alias("feature"), F.lit(WORD_WEIGHT).alias("weight")))]
        for width, weight in GRAM_WEIGHTS.items():
            many = F.length(padded) - width + 1
            made = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), _gram(padded, width, weight))
            parts.append(F.when(many > 0, made).otherwise(empty))
        return F.concat(*parts)

    singles = F.flatten(F.transform(words, grams))
    return F.concat(singles, F.transform(neighbours(words), lambda f: F.struct(f.alias("feature"), F.lit(PAIR_WEIGHT).alias("weight"))))


def neighbours(words: Column) -> Column:
    """The features of pairs of neighbours."""
    empty = F.array().cast("array<string>")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    return F.when(F.size(words) > 1, pairs).otherwise(empty)


def _gram(padded: Column, width: int, weight: float) -> Callable[[Column], Column]:
    def make(i: Column) -> Column:
        return F.struct(F.concat(F.lit(f"c{width}:"), F.substring(padded, i, F.lit(width))).alias("feature"), F.lit(weight).alias("weight"))

    return make


class EmbeddingProvider(Protocol):
    """Turns texts into rows of unit length. Anything with these members can be used by embed()."""

    dimension: int
    provider_id: str

    def encode_texts(self, texts: list[str]) -> np.ndarray: ...

    def encode_query(self, query: str) -> np.ndarray: ...


def _unit(rows: np.ndarray) -> np.ndarray:
    if not np.isfinite(rows).all():
        raise ValueError("an embedding holds values that are not finite")
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    if (lengths <= np.finfo(float).eps).any():
        raise ValueError("an embedding has length zero")
    return rows / lengths


class _Provider:
    def encode_query(self, query: str) -> np.ndarray:
        if not query.strip():
            raise ValueError("the query is blank")
        return self.encode_texts([query])[0]


class HashProvider(_Provider):
    """Signed feature hashing of words, character n-grams and word pairs by BLAKE2b."""

    def __init__(self, dimension: int = 384):
        if dimension < 16:
            raise ValueError("dimension must be at least 16")
        self.dimension, self.provider_id = dimension, f"deterministic-hash-v1:{dimension}"

    def place(self, feature: str) -> tuple[int, float]:
        digest = hashlib.blake2b(feature.encode(), digest_size=16).digest()
        return int.from_bytes(digest[:8], "little") % self.dimension, 1.0 if digest[8] & 1 else -1.0

    def features(self, text: str) -> Iterator[tuple[str, float]]:
        words = re.findall(TOKEN, fold(text))
        for word in words:
            yield from word_features(word)
        yield from ((f"b:{a}_{b}", PAIR_WEIGHT) for a, b in zip(words, words[1:], strict=False))

    def _hashed(self, word: str, grams: dict) -> tuple[list[int], list[float]]:
        """Places and signed weights of a word's features; n-grams, which many words share, are kept in grams."""
        places, weights = [], []
        for n, (feature, weight) in enumerate(word_features(word)):
            kept = grams.get(feature)
            if kept is None:
                kept = self.place(feature)
                if n:
                    if len(grams) >= KEPT_PAIRS:
                        grams.clear()
                    grams[feature] = kept
            places.append(kept[0])
            weights.append(kept[1] * weight)
        return places, weights

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        """The sums over features(), in its order. A word's features are hashed once and kept together, so a text costs a lookup a word and one a pair."""
        out, words_kept, pairs_kept, grams, characters = np.zeros((len(texts), self.dimension)), {}, {}, {}, 0
        for row, text in zip(out, texts, strict=True):
            words = re.findall(TOKEN, fold(text))
            for lo in range(0, len(words), SOME_WORDS):
                places, weights = [], []
                for word in words[lo : lo + SOME_WORDS]:
                    if (kept := words_kept.get(word)) is None:
                        characters += len(word) + 16
                        if characters > KEPT_CHARACTERS:
                            words_kept, characters = {}, len(word) + 16
                        kept = words_kept[word] = self._hashed(word, grams)
                    places += kept[0]
                    weights += kept[1]
                np.add.at(row, np.array(places, np.int64), np.array(weights))
            for lo in range(0, len(words) - 1, SOME_WORDS):
                some = words[lo : lo + SOME_WORDS + 1]
                places = []
                for pair in zip(some, some[1:], strict=False):
                    if (kept := pairs_kept.get(pair)) is None:
                        if len(pairs_kept) >= KEPT_PAIRS:
                            pairs_kept = {}
                        place, sign = self.place("b:%s_%s" % pair)
                        kept = pairs_kept[pair] = place if sign > 0 else ~place
                    places.append(kept)
                at = np.array(places, np.int64)
                np.add.at(row, np.where(at < 0, ~at, at), np.where(at < 0, -PAIR_WEIGHT, PAIR_WEIGHT))
            if not row.any():
                place, sign = self.place("empty")
                row[place] = sign
        return _unit(out)


def word_features(word: str) -> Iterator[tuple[str, float]]:
    """A word and the character n-grams of ^word$."""
    yield f"w:{word}", WORD_WEIGHT
    padded = f"^{word}$"
    for width, weight in GRAM_WEIGHTS.items():
        yield from ((f"c{width}:{padded[i : i + width]}", weight) for i in range(len(padded) - width + 1))


class FastHashProvider(_Provider):
    """Signed hashing of words of two or more characters and their pairs; cheaper than HashProvider. Text without tokens has the feature
    "empty", so that no vector is zero."""

    def __init__(self, dimension: int = 384):
        if dimension < 16:
            raise ValueError("dimension must be at least 16")
        self.dimension, self.provider_id = dimension, f"fast-hash-v1:{dimension}"

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        out, seen = np.zeros((len(texts), self.dimension)), {}
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\b\w\w+\b", fold(text))
            for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))] or ["empty"]:
                if feature not in seen:
                    number = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=5).digest(), "little")
                    seen[feature] = (number >> 1) % self.dimension, 1.0 if number & 1 else -1.0
                place, sign = seen[feature]
                row[place] += sign
            if not row.any():
                row[0] = 1.0
        return _unit(out)


class ModelProvider(_Provider):
    """A sentence-transformers model, if that package is there; prefixes are put before passages and queries as some models want."""

    def __init__(self, model: str, passage: str = "", query: str = "", loader: Callable | None = None, kind: str = "sentence-transformers"):
        if loader is None:
            if importlib.util.find_spec("sentence_transformers") is None:
                raise RuntimeError("this provider needs the package sentence-transformers")
            from sentence_transformers import SentenceTransformer as loader  # noqa: N813
        self.model, self.passage, self.query = loader(model), passage, query
        self.dimension, self.provider_id = int(self.model.get_sentence_embedding_dimension()), f"{kind}:{model}"

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        return _unit(np.asarray(self.model.encode([self.passage + t for t in texts]), float))

    def encode_query(self, query: str) -> np.ndarray:
        if not query.strip():
            raise ValueError("the query is blank")
        return _unit(np.asarray(self.model.encode([self.query + query]), float))[0]


class RemoteProvider(_Provider):
    """An HTTP service that takes {"model", "input"} and returns {"data": [{"embedding"}]}."""

    def __init__(self, model: str, dimension: int = 1536, url: str | None = None, key: str | None = None, post: Callable | None = None):
        self.model, self.dimension, self.provider_id = model, dimension, f"remote:{model}:{dimension}"
        self.url, self.key, self.post = url or os.environ.get("EMBEDDING_URL"), key or os.environ.get("EMBEDDING_KEY"), post or self._post
        if post is None and not self.url:
            raise RuntimeError("this provider needs EMBEDDING_URL")

    def _post(self, body: dict) -> dict:
        call = request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with request.urlopen(call, timeout=60) as answer:
            return json.load(answer)

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        answer = self.post({"model": self.model, "input": texts, "dimensions": self.dimension})
        return _unit(np.asarray([x["embedding"] for x in answer["data"]], float))


def create_provider(name: str = "hash", dimension: int = 384, model: str | None = None) -> EmbeddingProvider:
    small, e5 = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", "intfloat/multilingual-e5-small"
    if name == "auto":
        name = "sentence-transformers" if importlib.util.find_spec("sentence_transformers") else "hash"
    makers = {
        "hash": lambda: HashProvider(dimension),
        "fast-hash": lambda: FastHashProvider(dimension),
        "sklearn-hash": lambda: FastHashProvider(dimension),
        "sentence-transformers": lambda: ModelProvider(model or small),
        "multilingual-e5": lambda: ModelProvider(model or e5, "passage: ", "query: ", kind="multilingual-e5"),
        "e5": lambda: ModelProvider(model or e5, "passage: ", "query: ", kind="multilingual-e5"),
        "openai": lambda: RemoteProvider(model or "text-embedding-3-small", dimension),
    }
    if name not in makers:
        raise ValueError(f"unknown embedding provider {name}; there are {', '.join([*makers, 'auto'])}")
    return makers[name]()


def embed(df: DataFrame, text_column: str, provider: EmbeddingProvider, out: str = "embedding") -> DataFrame:
    """df with a column of unit vectors, encoded in Arrow batches."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(provider.encode_texts(texts.fillna("").tolist())) if len(texts) else [])

    return df.withColumn(out, encode(F.col(text_column)))
