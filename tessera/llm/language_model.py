"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Model. A token's probability is P(class | context) * P(token | class, context); both factors are trained maximum-entropy models with n-gram and
skip features. Classes are CLASSES groups of words by a hash of their last two bytes (endings, which tell languages and sentence places apart); the
end token is a class of its own.

- P(class | context) is a softmax over hashed features of the two tokens before: the n-gram feature (a hash of the last token), the skip
  feature (the class of the token before it), and the two together.
- P(token | class, context) = u(token) * exp(w[n-gram, token] + w[skip, token]) / Z(class, context). u is the token's smoothed share of
  its class (`alpha` for each known token and once for all unknown ones, which have no weights). The weights belong to hashed pairs of a
  context feature and a token: tokens of a class that share a bucket (BUCKETS a class) share their weights. So Z needs
  the summed u of each bucket only, is exact over the whole vocabulary, and is a matrix product.

The probabilities of all tokens add up to one in every context.

Training. Contexts with equal features have equal gradients, so all training tokens are first counted by (context, class) and by hashed pair:
CONTEXTS * CLASSES + CLASSES * BUCKETS cells at most whatever the corpus, added up in every task before they are shuffled. Each gradient
round is then a Spark job. For the classes its tasks hold ranges of contexts, and a feature of the last token is touched by one task
only, so tasks return sparse rows whose sum is one matrix, however many tasks there are. For the tokens a task holds whole classes, computes their
normalisers and expected feature counts, and returns these. Rates of the second are those of iterative scaling (half the log ratio of the observed
and the expected count, as two features are active), under which the likelihood never falls. All training documents take part; nothing is sampled.

Counts of tokens. A first pass gives each partition's distinct words with their numbers in training documents. A window over equal words (a
row per partition at most, so no word is hot) adds them up, and the sums return to the partitions that asked, as one sorted file each in
the shared folder. The scoring pass reads the same partitions and looks its words up there. So the vocabulary is never in one place, texts
are never shuffled, and what is gathered grows with the corpus. Both passes must see the same partitions: a plan other than a plain
file scan is written out first, and a word that its file lacks is an error, not a zero.

Files are written under temporary names and renamed; a repeated task writes the same bytes, so lost executors do no harm.

Defined results: a null or empty text has only the end token; a null doc_id is not held out; rows with equal ids are documents of their own;
without any training document all counts are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.shared import materialise, scratch, shuffle_partitions, tune

CLASSES = 32
LAST = 1 << 10  # buckets of the last token
CONTEXTS = LAST * CLASSES
CELLS = CONTEXTS * CLASSES
SPLITS = 4  # buckets of the class before it, for each bucket of the last token
FEATURES = 1 + CLASSES + LAST + LAST * SPLITS
BUCKETS = 1 << 13  # buckets of tokens in a class, and weights of a class
NEAR = 1 << 8  # buckets of the last token for the weights of tokens
ALPHA = 0.1
ROUNDS = 10
WORD_ROUNDS = 6
RIDGE = 1.0
#: Added to observed and expected counts of a token's feature: how many observations a weight needs.
PRIOR = 2.0
#: Contexts, and classes, are dealt to so many tasks in a gradient round.
GRADIENT_TASKS = 8

_SPACE = textkit.space_words()
#: Stands for what comes before a text.
_START = np.uint64(0x51ED270B1F0A3C77)


def classes_of(w: textkit.Words) -> np.ndarray:
    """1 .. CLASSES - 1 for words; 0 is the end token's."""
    last = textkit.LOWER[w.data[w.ends - 1]].astype(np.uint64)
    before = np.where(w.ends - w.starts > 1, textkit.LOWER[w.data[np.maximum(w.ends - 2, 0)]], 0).astype(np.uint64)
    return (textkit.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(CLASSES - 1)).astype(np.int64) + 1


def feature_places() -> np.ndarray:
    """(CONTEXTS, 4) the features of each context: bias, class before the last token, last token, both. The last two belong to one last token each."""
    context = np.arange(CONTEXTS)
    last, before = context // CLASSES, context % CLASSES
    pair = last * SPLITS + (textkit.mix(before.astype(np.uint64) + np.uint64(99)) % np.uint64(SPLITS)).astype(np.int64)
    return np.stack([np.zeros(CONTEXTS, np.int64), 1 + before, 1 + CLASSES + last, 1 + CLASSES + LAST + pair], axis=1)


#: What a context feature adds (by exclusive or) to a token's bucket to give the pair's weight.
_KEYS = np.random.default_rng(20240611).permutation(BUCKETS)[: NEAR + CLASSES].astype(np.int64)


def pair_places(hashes: np.ndarray, classes: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each token's n-gram pair and skip pair."""
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    base = classes * BUCKETS
    return base + (_KEYS[(context // CLASSES) % NEAR] ^ bucket), base + (_KEYS[NEAR + context % CLASSES] ^ bucket)


def tokens_of(w: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the words and end of every text, in order: hash (0 for the end), class, context, and the first token of each text."""
    n = len(w.first) - 1
    total = len(w.starts) + n
    ends = w.first[1:] + np.arange(n)  # places of the end tokens
    word = np.ones(total, bool)
    word[ends] = False
    hashes, classes = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    hashes[word], classes[word] = w.hashes(), classes_of(w) if len(w.starts) else 0
    first = w.first[:-1] + np.arange(n)
    last, before = np.empty(total, np.uint64), np.empty(total, np.int64)
    last[1:], before[2:] = hashes[:-1], classes[:-2]
    before[:2] = 0
    last[first], before[first] = _START, 0
    second = first[ends > first] + 1
    before[second] = 0
    context = (textkit.mix(last) % np.uint64(LAST)).astype(np.int64) * CLASSES + before
    return hashes, classes, context, np.append(first, total)


def _stable(docs: DataFrame) -> DataFrame:
    """docs, read by a plain scan, so that its partitions are the same each time."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    plain = "FileScan" in plan and not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "InMemory", "Sample", "Union", "Join"))
    return docs if plain else materialise(docs, "stable")


def _rows(docs: DataFrame) -> DataFrame:
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return docs.select("doc_id", "text", out.alias("held_out"))


def _held(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def partition_words(rows: DataFrame) -> DataFrame:
    """(part, word, n): each partition's distinct words by hash, with their class in the low bits' place, and their numbers in training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, kinds, held = [], [], [], 0
        for batch in batches:
            out = _held(batch)
            for lo, hi, data, offsets in textkit.slices(batch.column("text")):
                w = textkit.words_of(data, offsets, _SPACE)
                if not len(w.starts):
                    continue
                trained = np.repeat(~out[lo:hi], w.counts)
                word, at, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                keys.append(word)
                counts.append(np.bincount(inverse, weights=trained, minlength=len(word)))
                kinds.append(classes_of(w)[at])
                held += len(word)
            if held > 3_000_000:  # a partition may hold many batches
                word, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                counts, kinds, keys = [np.bincount(inverse, weights=np.concatenate(counts))], [np.concatenate(kinds)[at]], [word]
                held = -2 * len(word)
        if keys:
            word, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n, kind = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64), np.concatenate(kinds)[at]
            part = TaskContext.get().partitionId()
            for a in range(0, len(word), 50_000):
                b = min(a + 50_000, len(word))
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(b - a, part, np.int32)), "word": pa.array(word[a:b].view(np.int64)), "kind": pa.array(kind[a:b].astype(np.int32)), "n": pa.array(n[a:b])})

    return rows.mapInArrow(count, "part int, word long, kind int, n long")


def word_totals(words: DataFrame) -> DataFrame:
    """words with c, the word's count over all partitions, and whether this is the word's first row."""
    own = Window.partitionBy("word").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(Window.partitionBy("word").orderBy("part")) == 1
    return words.select("part", "word", "kind", F.sum("n").over(own).alias("c"), first.alias("is_first"))


def class_totals(totals: DataFrame, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training tokens, distinct training tokens) of each class, and (CLASSES, BUCKETS, 2) the same of each bucket."""
    bucket = F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")
    known = totals.where("is_first and c > 0").groupBy("kind", bucket).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    found = known.toArrow()  # CLASSES * BUCKETS rows at most
    buckets = np.zeros((CLASSES, BUCKETS, 2))
    place = np.asarray(found["kind"]), np.asarray(found["bucket"])
    buckets[*place, 0], buckets[*place, 1] = np.asarray(found["n"]), np.asarray(found["v"])
    tokens, distinct = buckets.sum(axis=1).astype(np.int64).T
    tokens[0], distinct[0] = ends, int(ends > 0)
    return tokens, distinct, buckets


def class_sizes(tokens: np.ndarray, distinct: np.ndarray, alpha: float) -> np.ndarray:
    """What a known token's count plus alpha is divided by to give its share u of its class; nothing but the end is in class 0."""
    kinds = np.arange(CLASSES)
    return tokens + alpha * np.maximum(distinct, kinds == 0) + np.where(kinds == 0, 0.0, alpha)


def write_lookups(totals: DataFrame, folder: str, parts: int) -> None:
    """A file per partition (of which there are `parts`): its words, ascending, and their counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, words, counts = None, [], []

        def close() -> None:
            word, c = np.concatenate(words).view(np.uint64), np.concatenate(counts)
            order = np.argsort(word)
            name = f"{base}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(name) as f:
                f.write(np.int64(len(word)).tobytes() + word[order].tobytes() + c[order].astype("<i8").tobytes())
            fs.move(name, f"{base}/part-{part}.words")

        done = 0
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if part is not None and part != parts[a]:
                    close()
                    words, counts = [], []
                    done += 1
                part = int(parts[a])
                words.append(np.asarray(batch.column("word"))[a:b])
                counts.append(np.asarray(batch.column("c"))[a:b])
        if part is not None:
            close()
            done += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([done], pa.int64())})

    n = max(shuffle_partitions(totals.sparkSession), parts)
    dealt = totals.select("part", "word", "c").repartition(n, "part").sortWithinPartitions("part")
    dealt.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def feature_cells(rows: DataFrame) -> DataFrame:
    """(cell, n) over all training tokens: cells of (context, class) first, then those of the hashed pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + CLASSES * BUCKETS, np.int64)
        for batch in batches:
            out = _held(batch)
            for lo, hi, data, offsets in textkit.slices(batch.column("text")):
                hashes, classes, context, first = tokens_of(textkit.words_of(data, offsets, _SPACE))
                trained = np.repeat(~out[lo:hi], np.diff(first))
                hashes, classes, context = hashes[trained], classes[trained], context[trained]
                total[:CELLS] += np.bincount(context * CLASSES + classes, minlength=CELLS)
                for place in pair_places(hashes, classes, context):
                    total[CELLS:] += np.bincount(place, minlength=CLASSES * BUCKETS)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 50_000):
            part = at[a : a + 50_000]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(part.astype(np.int32)), "n": pa.array(total[part])})

    return rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _dense(cells: DataFrame, size: int) -> np.ndarray:
    """A vector from rows (cell, n), of which there are `size` at most."""
    found = cells.toArrow()
    out = np.zeros(size)
    out[np.asarray(found["cell"])] = np.asarray(found["n"])
    return out


def class_chances(weights: np.ndarray, contexts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """log P(class | context) for rows of contexts."""
    out = np.empty((len(contexts), CLASSES))
    for a in range(0, len(contexts), 4096):
        z = weights[places[contexts[a : a + 4096]]].sum(axis=1)
        z -= z.max(axis=1, keepdims=True)
        out[a : a + 4096] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


_GRADIENT = "feature int, g binary, h binary, likelihood double, tokens long"


def train_classes(cells: DataFrame, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, list[float]]:
    """(weights, best mean log-likelihood a token before each round) from rows (cell, n): each round is a job over the cells."""
    spark = cells.sparkSession
    # a task has a range of last tokens, so features of the last token come from one task
    dealt = materialise(cells.where(F.col("cell") < CELLS).repartitionByRange(GRADIENT_TASKS, "cell"), "context-cells").coalesce(GRADIENT_TASKS)
    weights, history, pace, before = np.zeros((FEATURES, CLASSES)), [], 1.0, None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = [(np.asarray(b.column("cell")), np.asarray(b.column("n"))) for b in batches if b.num_rows]
            if not found:
                return
            w, places = sent.value, feature_places()
            cell, count = (np.concatenate(x) for x in zip(*found, strict=True))
            contexts, row = np.unique(cell // CLASSES, return_inverse=True)
            n = np.zeros((len(contexts), CLASSES))
            n[row, cell % CLASSES] = count
            logs = class_chances(w, contexts, places)
            p, size = np.exp(logs), n.sum(axis=1, keepdims=True)
            g, h = np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES))
            for k in range(places.shape[1]):
                np.add.at(g, places[contexts, k], n - size * p)
                np.add.at(h, places[contexts, k], size * p * (1 - p))
            own = np.unique(places[contexts])
            likelihood, tokens = np.zeros(len(own)), np.zeros(len(own), np.int64)
            likelihood[0], tokens[0] = (n * logs).sum(), size.sum()
            yield pa.RecordBatch.from_pydict({"feature": pa.array(own.astype(np.int32)), "g": [x.tobytes() for x in g[own]], "h": [x.tobytes() for x in h[own]], "likelihood": likelihood, "tokens": tokens})

        # FEATURES rows, and one more a task for each feature that tasks share: of fixed size, whatever the corpus
        parts = dealt.mapInArrow(gradient, _GRADIENT).toArrow()
        g, h = np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES))
        for x, column in ((g, "g"), (h, "h")):
            np.add.at(x, np.asarray(parts["feature"]), np.frombuffer(b"".join(parts[column].to_pylist())).reshape(-1, CLASSES))
        history.append(np.asarray(parts["likelihood"]).sum() / max(1, np.asarray(parts["tokens"]).sum()))
        sent.unpersist()
        if before is not None and history[-1] < max(history[:-1]):
            weights, g, h = before  # too far: go back and take half the step
            pace /= 2
            history[-1] = max(history[:-1])
        before = (weights, g, h)
        # a context's features move together, so each takes its share of a Newton step, and none moves by more than 1
        weights = weights + np.clip(pace * (g - ridge * weights) / (4 * (h + ridge)), -1, 1)
    return weights, history


def normaliser(weights: np.ndarray, mass: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(Z, expected counts of the weights) of a class. weights and mass (the summed u) are by bucket; n: tokens of the class by (n-gram, skip)."""
    tilt = np.exp(weights)
    bucket = np.flatnonzero(mass)
    place, skip = _KEYS[:NEAR, None] ^ bucket[None, :], _KEYS[NEAR:, None] ^ bucket[None, :]
    near, far = tilt[place] * mass[bucket], tilt[skip]
    z = (1 - mass.sum()) + near @ far.T
    if n is None:
        return z, None
    ratio = n / z
    expected = np.bincount(place.reshape(-1), weights=(near * (ratio @ far)).reshape(-1), minlength=BUCKETS)
    expected += np.bincount(skip.reshape(-1), weights=(far * (ratio.T @ near)).reshape(-1), minlength=BUCKETS)
    return z, expected


def train_words(spark: SparkSession, cells: np.ndarray, pairs: np.ndarray, mass: np.ndarray, rounds: int = WORD_ROUNDS, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights by class and bucket, Z by class, n-gram and skip bucket, mean log-likelihood a token above that of u before each round).
    Each round is a job over the classes; cells, pairs and mass are of fixed size."""
    n = cells.reshape(LAST // NEAR, NEAR, CLASSES, CLASSES).sum(axis=0)  # n-gram, skip, class
    observed, weights, history = pairs.reshape(CLASSES, BUCKETS), np.zeros((CLASSES, BUCKETS)), []
    fixed = spark.sparkContext.broadcast((mass, n))
    total = max(1.0, n.sum())
    classes = spark.range(1, CLASSES, 1, GRADIENT_TASKS)
    while True:
        last = len(history) == rounds
        sent = spark.sparkContext.broadcast(weights)

        def step(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            w, (u, count) = sent.value, fixed.value
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    z, expected = normaliser(w[k], u[k], None if last else count[:, :, k])
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([k], pa.int32()), "z": [z.tobytes()], "expected": [b"" if last else expected.tobytes()]})

        z, expected = np.ones((CLASSES, NEAR, CLASSES)), np.zeros((CLASSES, BUCKETS))
        for r in classes.mapInArrow(step, "kind int, z binary, expected binary").toArrow().to_pylist():  # CLASSES rows of 128 KB
            z[r["kind"]] = np.frombuffer(r["z"]).reshape(NEAR, CLASSES)
            if not last:
                expected[r["kind"]] = np.frombuffer(r["expected"])
        sent.unpersist()
        if last:
            return weights, z, history
        history.append(float((observed * weights).sum() - (np.moveaxis(n, 2, 0) * np.log(z)).sum()) / total)
        weights = weights + 0.5 * np.log((observed + prior) / (expected + prior))


@dataclass
class Model:
    """What scoring needs, all of fixed size: log10 P(class | context), token weights and log10 Z, and the totals of the training tokens."""

    classes: np.ndarray
    words: np.ndarray
    z: np.ndarray
    tokens: np.ndarray
    distinct: np.ndarray

    def log10(self, hashes: np.ndarray, classes: np.ndarray, context: np.ndarray, c: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
        """log10 P of each token; c is its count in training tokens."""
        one, two = pair_places(hashes, classes, context)
        tilt = np.where((c > 0) & (classes > 0), self.words[one].astype(np.float64) + self.words[two], 0.0)
        share = np.log10((c + alpha) / class_sizes(self.tokens, self.distinct, alpha)[classes])
        near, skip = (context // CLASSES) % NEAR, context % CLASSES
        return self.classes[context, classes].astype(np.float64) + share + tilt - self.z[classes, near, skip]


def score(rows: DataFrame, folder: str, model: Model, alpha: float = ALPHA) -> DataFrame:
    """One row per document; the lookup files of folder belong to the partitions of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    total, vocabulary, ends = int(model.tokens.sum()), int(model.distinct.sum()), int(model.tokens[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known, count = None, None
        for batch in batches:
            out = _held(batch)
            parts = []
            for _, _, data, offsets in textkit.slices(batch.column("text")):
                hashes, classes, context, first = tokens_of(textkit.words_of(data, offsets, _SPACE))
                c = np.full(len(hashes), ends, np.int64)
                word = classes > 0
                if word.any():
                    if known is None:
                        fs, base = pafs.FileSystem.from_uri(folder)
                        with fs.open_input_stream(f"{base}/part-{TaskContext.get().partitionId()}.words") as f:
                            raw = f.read()
                        n = int(np.frombuffer(raw, np.int64, 1)[0])
                        known, count = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
                    distinct_words, inverse = np.unique(hashes[word], return_inverse=True)
                    at = np.minimum(np.searchsorted(known, distinct_words), len(known) - 1)
                    if (known[at] != distinct_words).any():
                        raise RuntimeError("a partition holds words that it did not hold when they were counted")
                    c[word] = count[at][inverse]
                base_logs = np.log10((c + alpha) / (total + alpha * (vocabulary + 1)))
                own = model.log10(hashes, classes, context, c, alpha)
                sums = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)  # noqa: E731  every text has an end
                parts.append((np.diff(first), sums((c > 0).astype(np.int64)), sums(base_logs), sums(own)))
            size, seen, base_score, own_score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()), "held_out": pa.array(out), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(seen.astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(out), total, np.int64)), "base_score": pa.array(base_score.astype(np.float64)), "score": pa.array(own_score.astype(np.float64)),
                }
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def trained(rows: DataFrame, totals: DataFrame, ends: int, rounds: int = ROUNDS, word_rounds: int = WORD_ROUNDS, alpha: float = ALPHA) -> Model:
    """Both factors, from the counts of training tokens."""
    tokens, distinct, buckets = class_totals(totals, ends)
    mass = (buckets[:, :, 0] + alpha * buckets[:, :, 1]) / class_sizes(tokens, distinct, alpha)[:, None]
    cells = materialise(feature_cells(rows), "feature-cells")
    weights, _ = train_classes(cells, rounds)
    counts = _dense(cells, CELLS + CLASSES * BUCKETS)
    words, z, _ = train_words(rows.sparkSession, counts[:CELLS], counts[CELLS:], mass, word_rounds)
    logs = class_chances(weights, np.arange(CONTEXTS), feature_places()) / np.log(10)
    return Model(logs.astype(np.float32), (words.reshape(-1) / np.log(10)).astype(np.float32), np.log10(z), tokens, distinct)


def language_scores(docs: DataFrame, rounds: int = ROUNDS, word_rounds: int = WORD_ROUNDS, alpha: float = ALPHA) -> DataFrame:
    """Learn from the documents that are not held out, and score all."""
    spark = docs.sparkSession
    tune(spark)
    rows = _rows(_stable(docs.select("doc_id", "text")))
    totals = materialise(word_totals(partition_words(rows)), "word-totals")
    ends = rows.where("not held_out").count()
    folder = scratch(spark, "word-lookups")
    write_lookups(totals, folder, rows.rdd.getNumPartitions())
    return score(rows, folder, trained(rows, totals, ends, rounds, word_rounds, alpha), alpha)


def reference_base(texts: list[tuple], alpha: float = ALPHA) -> dict:
    """Brute force for tests: doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    import math
    import re
    import zlib
    from collections import Counter

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + alpha) / (n + alpha * (v + 1))) for w in ws)) for i, ws in words.items()}
