"""Secret scan: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Base rules (assign, access, hex) find secrets by form; their spans always stay. Beyond them, runs of at least MIN_RUN characters of
[A-Za-z0-9+/_=-] are scored: the mean over the characters of log P_random(next | current) - log P_ordinary(next | current). A run above
THRESHOLD nats a character that mixes letters and digits is a `markov` span, unless it overlaps a base span.

Training. Labelled samples are strings with a label, 1 for random. From a corpus they come of themselves: what the base rules
caught is random, and words without digits and short runs with some are ordinary, as is the fixed list ORDINARY. Each Arrow
batch adds its character pairs up to one matrix per label, so a task sends 2 * 66 * 66 numbers whatever it read; all rows
take part. The random model is mixed half with an even one, as no corpus shows all kinds of keys.

Scanning works on the bytes of whole batches: the rules' keywords are searched first, and a rule's pattern only runs over texts
that hold one. Patterns are ASCII only, so byte matches are code-point matches; offsets are converted.

Defined results: null text counts as empty; rows are independent, repeated rows and ids give a row each; an empty table gives an empty
result; without any sample both models are even and no markov span is found; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.shared import spans_text, tune

# Fixed values ----------------------------------------------------------------------------------------------------------
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Ordinary identifiers, a labelled sample that goes with any corpus: prose has no underscores, dates or numbered names.
ORDINARY = """
get_value set_value from_index to_string user_account account_identifier customer_address order_number line_item_total
created_at updated_at deleted_at is_valid has_permission max_length min_length default_timeout_seconds request_handler response_body
HttpRequest HttpResponse StringBuilder ArrayList FileInputStream ThreadPoolExecutor DataFrameReader SparkSession ThisIsAName CamelCaseName
application/json text/html image/png content-type user-agent cache-control last-modified main-page front-end back-end
2019-01-01 2020-12-31 2021-06-15 2022-03-08 2023-11-30 2024-02-29 2025-10-10 1999-12-31 report-final-v1 report-final-v2 version-2 release-10
chapter_1 section_2 figure_3 table_4 page_12 file_2020 file_2021 file_2022 file_2023 file_2024 index_10 item_100 step_1000 level_2 part_3 test_1
src/main/java src/test/python usr/local/bin home/user/documents var/log/messages images/photos/summer index/page/home document_of_the_year
name_first name_last email_address phone_number postal_code country_code city_name street_name house_number date_of_birth
""".split()
#: How often each of them counts.
ORDINARY_WEIGHT = 20

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MIN_RUN = 16
THRESHOLD = 3.0

_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_RUN = _CODE >= 0
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(ALPHABET[:52].encode(), np.uint8)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
N = len(ALPHABET)


def _runs(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the longest runs of a class within each text, of at least so many bytes."""
    w = textkit.words_of(data, offsets, lut)
    long = w.ends - w.starts >= least
    return w.starts[long], w.ends[long]


def _texts_with(raw: bytes, offsets: np.ndarray, needles: tuple[bytes, ...]) -> np.ndarray:
    """Numbers of the texts in which one of the needles begins."""
    found = []
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            found.append(row)
            at = raw.find(needle, int(offsets[row + 1]))
            # a needle that crossed into the next text is found by the next text's own bytes or not at all
    return np.unique(np.asarray(found, np.int64))


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(text, kind, start, end) in bytes of the slice, by text."""
    raw, lowered = data.tobytes(), textkit.LOWER[data].tobytes()
    out = []
    for row in _texts_with(lowered, offsets, KEYWORDS):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        out += [(int(row), "assign", lo + m.start(), lo + m.end(), lo + m.start(2)) for m in ASSIGN.finditer(raw[lo:hi]) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for row in _texts_with(raw, offsets, (b"AKIA",)):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        out += [(int(row), "access", lo + m.start(), lo + m.end(), lo + m.start()) for m in ACCESS.finditer(raw[lo:hi]) if m.end() - m.start() >= LEAST["access"]]
    starts, ends = _runs(data, offsets, _HEX, LEAST["hex"])
    rows = np.searchsorted(offsets, starts, "right") - 1
    out += [(int(r), "hex", int(a), int(b), int(a)) for r, a, b in zip(rows, starts, ends, strict=True)]
    return out


def pair_counts(pieces: list[bytes]) -> np.ndarray:
    """N x N counts of character pairs within strings; other characters break a string."""
    if not pieces:
        return np.zeros(N * N, np.int64)
    codes = _CODE[np.frombuffer(b"\n".join(pieces), np.uint8)]
    a, b = codes[:-1], codes[1:]
    good = (a >= 0) & (b >= 0)
    return np.bincount(a[good] * N + b[good], minlength=N * N)


def _word_pairs(data: np.ndarray, offsets: np.ndarray, avoid: np.ndarray) -> np.ndarray:
    """Pair counts of ordinary words: runs without a digit, and short ones with, outside the positions to avoid."""
    if len(data) < 2:
        return np.zeros(N * N, np.int64)
    w = textkit.words_of(data, offsets, _RUN)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    barred = np.concatenate([[0], np.cumsum(avoid)])
    lengths = w.ends - w.starts
    good = (lengths >= 3) & (barred[w.ends] == barred[w.starts]) & ((digits[w.ends] == digits[w.starts]) | (lengths < MIN_RUN))
    at = textkit.gather_ranges(w.starts[good], lengths[good] - 1)
    return np.bincount(_CODE[data[at]] * N + _CODE[data[at + 1]], minlength=N * N)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(label, cell, n): character pairs of the corpus's own labelled samples, summed over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, N * N), np.int64)
        for batch in batches:
            for _, _, data, offsets in textkit.slices(batch.column("text")):
                spans = base_spans(data, offsets)
                avoid = np.zeros(len(data), bool)
                for _, _, a, b, _ in spans:
                    avoid[a:b] = True
                totals[1] += pair_counts([data[v:b].tobytes() for _, _, _, b, v in spans])
                totals[0] += _word_pairs(data, offsets, avoid)
        label, cell = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "cell": pa.array(cell, pa.int32()), "n": pa.array(totals[label, cell])})

    tune(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """The same from given labelled samples, rows (string, label) with label 1 for random."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, N * N), np.int64)
        for batch in batches:
            for value, label in zip(batch.column("string").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if value is not None and label in (0, 1):
                    totals[label] += pair_counts([value.encode()])
        label, cell = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "cell": pa.array(cell, pa.int32()), "n": pa.array(totals[label, cell])})

    return samples.select("string", "label").mapInArrow(count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))


def ratio_table(counts: DataFrame) -> np.ndarray:
    """log P_random(b | a) - log P_ordinary(b | a), N x N, from counts (at most 2 * N * N rows come to the driver)."""
    totals = np.zeros((2, N * N))
    for r in counts.collect():
        totals[r["label"], r["cell"]] = r["n"]
    if not totals.any():
        return np.zeros((N, N))
    ordinary, random = totals.reshape(2, N, N)
    chances = lambda x, prior: (x + prior) / (x + prior).sum(axis=1, keepdims=True)
    back = ordinary.sum(axis=0) + 1  # a rare character is followed as the others are
    ordinary = chances(ordinary + ORDINARY_WEIGHT * pair_counts([x.encode() for x in ORDINARY]).reshape(N, N), 5 * back / back.sum())
    random = 0.5 * chances(random, 0.5) + 0.5 / N
    return np.log(random) - np.log(ordinary)


def run_scores(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean log-likelihood ratio a character pair for each run."""
    if not len(starts):
        return np.zeros(0)
    lengths = ends - starts - 1
    at = textkit.gather_ranges(starts, lengths)
    sums = np.concatenate([[0.0], np.cumsum(table[_CODE[data[at]], _CODE[data[at + 1]]])])
    to = np.cumsum(lengths)
    return (sums[to] - sums[to - lengths]) / np.maximum(lengths, 1)


_SPANS = "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int,score:double>>"
_BASE_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ADDED_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def spans(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added spans in code points, by start, then kind as listed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            base: list[list] = [[] for _ in range(n)]
            added: list[list] = [[] for _ in range(n)]
            for lo, _, data, offsets in textkit.slices(batch.column("text")):
                found = base_spans(data, offsets)
                avoid = np.zeros(len(data) + 1, np.int64)
                for _, _, a, b, _ in found:
                    avoid[a] += 1
                    avoid[b] -= 1
                barred = np.concatenate([[0], np.cumsum(np.cumsum(avoid[:-1]) > 0)])
                starts, ends = _runs(data, offsets, _RUN, MIN_RUN)
                letters, digits = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_LETTER, _DIGIT))
                mixed = (letters[ends] > letters[starts]) & (digits[ends] > digits[starts]) & (barred[ends] == barred[starts])
                starts, ends = starts[mixed], ends[mixed]
                scores = run_scores(table, data, starts, ends)
                good = scores > threshold
                if not found and not good.any():
                    continue
                points = textkit.codepoints_before(data)
                for row, kind, a, b, _ in sorted(found, key=lambda s: (s[2], KINDS.index(s[1]))):
                    at = points[offsets[row]]
                    base[lo + row].append({"kind": kind, "start": int(points[a] - at), "end": int(points[b] - at)})
                for a, b, s in zip(starts[good], ends[good], scores[good], strict=True):
                    row = int(np.searchsorted(offsets, a, "right")) - 1
                    at = points[offsets[row]]
                    added[lo + row].append({"kind": "markov", "start": int(points[a] - at), "end": int(points[b] - at), "score": float(s)})
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "base": pa.array(base, _BASE_TYPE), "added": pa.array(added, _ADDED_TYPE)})

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(scan, _SPANS)


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Train on given samples, or on the corpus's own, and scan all texts."""
    counts = corpus_counts(docs) if samples is None else sample_counts(samples)
    return spans(docs, ratio_table(counts), threshold)


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text (by start, then kind)."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.transform(
        F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(ordered).alias("spans"), F.size("added").cast("long").alias("n_markov"))


def reference_digest(text: str | None) -> tuple[int, int, int, str]:
    """Brute force over one text, for tests: the base counts and hash."""
    text, out = text or "", []
    for m in re.finditer(ASSIGN.pattern.decode(), text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS.pattern.decode(), text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= LEAST["hex"]]
    out.sort()
    named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out)
    return (*[sum(k == i for _, k, _ in out) for i in range(3)], hashlib.sha256(named.encode()).hexdigest())
