"""Quality classifier by a weak-label model.

1. Heuristic labelers vote on each document from statistics of its whole text: good (1), bad (0) or nothing (2).
2. Vote patterns are counted over all documents (at most 3 ** 8 rows come to the driver), and expectation-maximisation estimates how
   accurate each labeler is, and each pattern's probability of a good document. No labelled row is needed.
3. A linear scorer on hashed features (words, and the statistics cut into bins) is trained by logistic regression with these
   probabilities as targets, on a sample of at most TRAIN_ROWS documents chosen by a hash of their id (the bound on what a fit may read). It
   carries the labelers' judgement over to documents on which they are silent or at odds.
4. Every document is scored in full; those below `threshold` are rejected.

Two passes over the texts, no shuffle but the counts, memory bounded by the Arrow batch.

Defined results: a null, empty or wordless text has no statistics, all labelers are silent, its score is the model's for no
words, and it is rejected, as it holds nothing to keep; rows are independent, so repeated rows and ids give a row each; an empty
table gives an empty result; other columns are kept (scored) or ignored (judged).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkit
from tessera.llm.shared import materialise, tune
from tessera.llm.weak_labels import reliabilities

TRAIN_ROWS = 4000
BUCKETS = 1 << 12
THRESHOLD = 0.5

# Fixed values ----------------------------------------------------------------------------------------------------------
SYMBOLS = b"!#$%&*|{}<>~^@\\_=+"
#: Common words of the four languages of the corpora in hand; other languages leave this labeler silent or outvoted.
COMMON = (
    "the of and to a in is that it for on was with as be this by are or an at from "
    "der die und das den von zu im mit ist für auf dem ein eine nicht "
    "de la le les et des en un une du que est dans pour qui au sur pas par "
    "el los y del se las por con una su para al lo como más"
).split()
#: (statistic, bad above, good below, least words); reversed bounds mean bad below and good above.
LABELERS = (
    ("symbols", 0.03, 0.01, 1),
    ("repeats", 0.10, 0.06, 20),
    ("upper", 0.30, 0.15, 20),
    ("variety", 0.30, 0.45, 50),
    ("top", 0.20, 0.15, 20),
    ("length", 8.5, 7.5, 20),
    ("lines", 0.40, 0.10, 20),
    ("common", 0.01, 0.05, 50),
)
STATISTICS = tuple(x[0] for x in LABELERS)

_SPACE = textkit.space_words()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(SYMBOLS, np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_NOT_LINE_END = np.ones(256, bool)
_NOT_LINE_END[[0x0A, 0x0D]] = False


def _hash_of(words: list[str]) -> np.ndarray:
    data, offsets = textkit.buffers(pa.array(words))
    return textkit.span_hashes(data, offsets[:-1], offsets[1:])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_doc(cumulated: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(cumulated[borders])


def _cumulated(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _grouped(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text: (hash, text, how often)."""
    order = np.argsort(hashes)
    order = order[np.argsort(docs[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


class Slice:
    """Statistics and distinct word hashes of the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        w = textkit.words_of(data, offsets, _SPACE)
        docs, counts = w.docs, w.counts
        hashes = w.hashes()
        self.n, self.counts = n, counts
        self.word, self.text, self.often = _grouped(hashes, docs, n)
        size = np.diff(offsets)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
        top = np.zeros(n, np.int64)
        np.maximum.at(top, self.text, self.often)
        letters = _per_doc(_cumulated(_LETTER[data]), offsets)
        points = _per_doc(textkit.codepoints_before(data), offsets)
        spaces = _per_doc(_cumulated(~_SPACE[data]), offsets)  # bytes of words
        lines = textkit.words_of(data, offsets, _NOT_LINE_END)
        _, line_doc, line_often = _grouped(lines.hashes(), lines.docs, n)
        common = np.isin(hashes, _COMMON_HASHES)
        values = {
            "symbols": _share(_per_doc(_cumulated(_SYMBOL[data]), offsets), size),
            "repeats": _share(np.bincount(docs[again], minlength=n), counts),
            "upper": _share(_per_doc(_cumulated(_UPPER[data]), offsets), letters),
            "variety": _share(np.bincount(self.text, minlength=n), counts),
            "top": _share(top, counts),
            "length": _share(points * _share(spaces, size), counts),
            "lines": _share(np.bincount(line_doc, weights=line_often - 1, minlength=n), lines.counts),
            "common": _share(np.bincount(docs[common], minlength=n), counts),
        }
        self.values = np.stack([values[k] for k in STATISTICS], axis=1)

    def votes(self) -> np.ndarray:
        """(texts, labelers) of 0, 1, 2."""
        out = np.full((self.n, len(LABELERS)), 2, np.int8)
        for k, (_, bad, good, least) in enumerate(LABELERS):
            x, enough = self.values[:, k], self.counts >= least
            out[enough & ((x > bad) if bad > good else (x < bad)), k] = 0
            out[enough & ((x < good) if bad > good else (x > good)), k] = 1
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, weight) triples: distinct words share a weight of 1, bins of the statistics count 1 each."""
        bucket = (self.word % np.uint64(BUCKETS)).astype(np.int64)
        weight = 1 / np.sqrt(np.maximum(np.bincount(self.text, minlength=self.n), 1))[self.text]
        edges = np.array([[bad, (bad + good) / 2, good] for _, bad, good, _ in LABELERS])
        bins = (self.values[:, :, None] > edges[None, :, :]).sum(axis=2)
        bins[self.counts[:, None] < np.array([least for *_, least in LABELERS])[None, :]] = 4  # too short for this one
        place = BUCKETS + np.arange(len(LABELERS))[None, :] * 5 + bins
        texts = np.repeat(np.arange(self.n), len(LABELERS))
        return np.concatenate([self.text, texts]), np.concatenate([bucket, place.reshape(-1)]), np.concatenate([weight, np.ones(len(texts))])


_COMMON_HASHES = _hash_of(COMMON)
WEIGHTS = BUCKETS + 5 * len(LABELERS) + 1  # the last is the bias


def vote_patterns(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: its votes, and the features of those in the training sample."""
    count = docs.count()
    chosen = F.pmod(F.xxhash64("doc_id", "text", F.lit("quality")), F.lit(1 << 30)) < int(min(1.0, train_rows / max(count, 1)) * (1 << 30))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = np.asarray(batch.column("chosen").to_numpy(zero_copy_only=False), bool)
            for lo, hi, data, offsets in textkit.slices(batch.column("text")):
                part = Slice(data, offsets)
                votes = ["".join(map(str, v)) for v in part.votes().tolist()]
                places: list = [None] * part.n
                if picked[lo:hi].any():
                    text, bucket, _ = part.features()
                    for i in np.flatnonzero(picked[lo:hi]):
                        places[i] = bucket[text == i].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"votes": votes, "places": pa.array(places, pa.list_(pa.int32()))})

    tune(docs.sparkSession)
    return docs.select("text", chosen.alias("chosen")).mapInArrow(vote, "votes string, places array<int>")


def sample_weights(places: np.ndarray) -> np.ndarray:
    """The weights that features() gives to a text's buckets."""
    words = places < BUCKETS
    return np.where(words, 1 / np.sqrt(max(1, int(words.sum()))), 1.0)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model by gradient steps with per-weight rates (Adagrad); rows are (buckets, weights, target)."""
    w, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
    if not rows:
        return w
    sizes = np.array([len(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    weight = np.concatenate([np.asarray(r[1]) for r in rows])
    target = np.array([r[2] for r in rows])
    for _ in range(rounds):
        z = np.bincount(row, weights=w[place] * weight, minlength=len(rows)) + w[-1]
        gap = (target - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) / len(rows)
        g = np.bincount(place, weights=gap[row] * weight, minlength=WEIGHTS) - ridge * w
        g[-1] = gap.sum()
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, float]]:
    """(weights of the scorer, probability of a good document for each vote pattern)."""
    voted = materialise(vote_patterns(docs, train_rows), "quality-votes")
    counts = {r["votes"]: float(r["count"]) for r in voted.groupBy("votes").count().collect()}  # at most 3 ** 8 rows
    post, _, _ = reliabilities(counts, [(0, 1)] * len(LABELERS), silence=False)
    sample = voted.where("places is not null").limit(2 * train_rows).toArrow()  # about train_rows rows; more only where many rows are alike
    if not len(sample) and counts:  # few different rows, and the hash met none of them
        sample = vote_patterns(docs.limit(train_rows), train_rows).toArrow()
    lists = sample["places"].combine_chunks()
    places = np.split(np.asarray(lists.flatten()), np.asarray(lists.offsets)[1:-1] - np.asarray(lists.offsets)[0]) if len(lists) else []
    rows = [(p, post[v]) for p, v in zip(places, sample["votes"].to_pylist(), strict=True)]
    return train_scorer([(places, sample_weights(places), target) for places, target in rows]), post


def scored(docs: DataFrame, model: tuple[np.ndarray, dict[str, float]], threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_words, quality_votes, quality_label (the weak label), quality_score and quality_kept."""
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(model)
    names = list(docs.columns)
    made = "quality_words long, quality_votes string, quality_label double, quality_score double, quality_kept boolean"
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(made).fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, post = sent.value
        for batch in batches:
            words, votes, scores = [], [], []
            for _, _, data, offsets in textkit.slices(batch.column("text")):
                part = Slice(data, offsets)
                text, bucket, weight = part.features()
                z = np.bincount(text, weights=weights[bucket] * weight, minlength=part.n) + weights[-1]
                scores.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
                words.append(part.counts)
                votes += ["".join(map(str, v)) for v in part.votes().tolist()]
            words, scores = (np.concatenate(x) if x else np.zeros(0) for x in (words, scores))
            kept = (scores >= threshold) & (words > 0)
            own = [batch.column(i) for i in range(len(names))]
            columns = [pa.array(words.astype(np.int64)), pa.array(votes, pa.string()), pa.array([post.get(v, 0.5) for v in votes], pa.float64()), pa.array(scores.astype(np.float64)), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*own, *columns], [*names, *made.replace(",", "").split()[::2]])

    return docs.mapInArrow(score, schema)


def judged(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, votes, weak_label, score and kept of every document."""
    docs = docs.select("doc_id", "text")
    out = scored(docs, fit(docs, train_rows), threshold)
    return out.select("doc_id", *[F.col(f"quality_{a}").alias(b) for a, b in (("words", "n_words"), ("votes", "votes"), ("label", "weak_label"), ("score", "score"), ("kept", "kept"))])


def good_documents(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects."""
    return scored(docs, fit(docs, train_rows), threshold).where("quality_kept").select(*docs.columns)
