"""Benchmark decontamination with an FM-index for each training shard.

Test phrases. A benchmark item gives every window of WINDOW consecutive words, or all its words as one window if it has fewer. Their distinct
words are the alphabet. The phrases are compiled on the driver and broadcast. A benchmark of more than BLOCK_BYTES is compiled in blocks, each with a pass of its own
whose result is written before the next block is made, and its long texts are cut into overlapping pieces with the same windows; so what the driver holds
and broadcasts stays bounded for any benchmark.

Index. A shard is a run of documents of about textkit.SLICE_BYTES. Its words are mapped to the alphabet; a word outside it can be
in no phrase and ends a run, and runs shorter than the shortest phrase are left out, as no phrase fits. The remaining
runs, each closed by a separator of its own, are the indexed text: suffix array by prefix doubling, Burrows-Wheeler transform
in a wavelet matrix, and sampled suffix positions (every SAMPLE-th word of a run, its first included, so a walk never leaves a run).

Search. All phrases go backwards together, one word a step, through wavelet ranks; those with empty ranges drop out. Occurrences
are located by walking to the next sampled position, and their spans merge per document.

Cost. One pass over the documents, no shuffle, memory bounded by the shard; nothing depends on how often a passage or word occurs
but the number of its occurrences. Words are compared by 64-bit hashes.

Defined results: a null or empty text has no words, an item without words no window; items with equal ids count once, a null id is
the id "null"; equal phrases of several items count for each; an empty benchmark hits nothing; rows are independent, so repeated
rows and ids give a row each; other columns are kept (clean_documents) or ignored (overlaps).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkit
from tessera.llm.shared import materialise, tune

WINDOW = 10
BLOCK_BYTES = 16 << 20
SAMPLE = 8


@dataclass
class Phrases:
    """Compiled windows: words[i, -lengths[i]:] are symbols from 1 on, items the numbers of the items of each window."""

    alphabet: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    first_item: np.ndarray
    items: np.ndarray
    names: list[str]


def compile_phrases(ids: list, texts: list[str | None], window: int = WINDOW) -> Phrases:
    data, offsets = textkit.buffers(pa.array(texts, pa.string()))
    w = textkit.words_of(data, offsets, textkit.alnum_words())
    alphabet, symbol = np.unique(w.hashes(), return_inverse=True)
    symbol = symbol.astype(np.int32) + 1
    names = sorted({"null" if i is None else str(i) for i in ids})
    number = {x: k for k, x in enumerate(names)}
    starts, lengths, owner = [], [], []
    for i, a, b in zip(ids, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b > a:
            size = min(window, b - a)
            starts.append(np.arange(a, b - size + 1))
            lengths.append(np.full(b - a - size + 1, size))
            owner.append(np.full(b - a - size + 1, number["null" if i is None else str(i)]))
    if not starts:
        none = np.zeros(0, np.int64)
        return Phrases(alphabet, np.zeros((0, window), np.int32), none, np.zeros(1, np.int64), none, names)
    starts, lengths, owner = np.concatenate(starts), np.concatenate(lengths), np.concatenate(owner)
    words = np.zeros((len(starts), window), np.int32)
    for k in range(window):
        has = lengths > k
        words[has, window - lengths[has] + k] = symbol[starts[has] + k]
    words, which = np.unique(words, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.reshape(-1), owner], axis=1), axis=0)
    return Phrases(alphabet, words, (words > 0).sum(axis=1), np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1], names)


class WaveletMatrix:
    """Rank queries over an integer sequence, many at once."""

    def __init__(self, values: np.ndarray, most: int):
        self.levels = []
        values = values.astype(np.int32)
        for bit in reversed(range(max(1, int(most).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(values) - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo = np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = (symbols >> bit & 1).astype(bool)
            a, b = before[at], before[lo]
            at = np.where(one, zeros + a, at - a)
            lo = np.where(one, zeros + b, lo - b)
        return at - lo

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for _, before, zeros in self.levels:
            one = before[at + 1] > before[at]
            out = out << 1 | one
            at = np.where(one, zeros + before[at], at - before[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols in which each 0 is a separator of its own, smaller than all symbols and than later separators."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (n + len(separators) + int(text.max(initial=0)) + 2) + behind
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Backward search over runs of symbols; each run in text ends with 0."""

    def __init__(self, text: np.ndarray):
        sa = suffix_array(text)
        self.n, most = len(text), int(text.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.bwt = WaveletMatrix(text[sa - 1], most)
        run_start = np.flatnonzero(np.concatenate([[True], text[:-1] == 0]))
        place = np.arange(self.n) - run_start[np.searchsorted(run_start, np.arange(self.n), "right") - 1]
        sampled = (place % SAMPLE == 0)[sa]
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [lo, hi) of all patterns, given from the right in words."""
        most = len(self.before) - 2
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        alive = np.arange(len(words))
        for step in range(1, words.shape[1] + 1):
            going = alive[lengths[alive] >= step]
            symbol = words[going, -step].astype(np.int64)
            known = symbol <= most
            hi[going[~known]] = lo[going[~known]]
            going, symbol = going[known], symbol[known]
            lo[going] = self.before[symbol] + self.bwt.rank(symbol, lo[going])
            hi[going] = self.before[symbol] + self.bwt.rank(symbol, hi[going])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        return lo, np.where(hi > lo, hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffix-array rows."""
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        going = np.arange(len(rows))
        rows = rows.copy()
        while len(going):
            at = rows[going]
            done = self.sampled_before[at + 1] > self.sampled_before[at]
            out[going[done]] = self.samples[self.sampled_before[at[done]]] + steps[going[done]]
            going = going[~done]
            at = rows[going]
            symbol = self.bwt.get(at)
            rows[going] = self.before[symbol] + self.bwt.rank(symbol, at)
            steps[going] += 1
        return out


def occurrences(phrases: Phrases, w: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, number of its first word in the shard, number of words) of every occurrence."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(w.starts):
        return none, none, none
    hashes = w.hashes()
    at = np.searchsorted(phrases.alphabet, hashes)
    at[at == len(phrases.alphabet)] = 0
    symbol = np.where(phrases.alphabet[at] == hashes, at + 1, 0)
    known = symbol > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    closes = known.copy()
    closes[:-1] &= ~known[1:]
    borders = w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(known))]
    opens[borders] = known[borders]
    closes[borders - 1] = known[borders - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    fits = ends - starts >= int(phrases.lengths.min())
    starts, lengths = starts[fits], (ends - starts)[fits]
    if not len(starts):
        return none, none, none
    source = textkit.gather_ranges(starts, lengths + 1)  # the place behind a run is its separator's
    text = np.zeros(len(source), np.int64)
    inside = np.ones(len(source), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    text[inside] = symbol[source[inside]]
    index = FMIndex(text)
    lo, hi = index.search(phrases.words, phrases.lengths)
    count = hi - lo
    window = np.repeat(np.arange(len(lo)), count)
    return window, source[index.locate(textkit.gather_ranges(lo, count))], phrases.lengths[window]


@dataclass
class Found:
    """Of the texts of a slice: words, merged hit spans (text, first byte, byte behind, words) and (text, item) pairs."""

    words: textkit.Words
    spans: np.ndarray
    items: np.ndarray


def hits(phrases: Phrases, data: np.ndarray, offsets: np.ndarray, earlier: list[tuple[int, int]] = ()) -> Found:
    """earlier: hit spans (first word, word behind) of the slice from other blocks of phrases, by word numbers in the slice."""
    w = textkit.words_of(data, offsets, textkit.alnum_words())
    window, first, length = occurrences(phrases, w)
    change = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    for a, b in earlier:
        change[a] += 1
        change[b] -= 1
    hit = np.cumsum(change[:-1]) > 0
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~hit[:-1]
    closes[:-1] &= ~hit[1:]
    borders = w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(hit))]
    opens[borders] = hit[borders]
    closes[borders - 1] = hit[borders - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text_of = lambda word: np.searchsorted(w.first, word, "right") - 1
    per = np.diff(phrases.first_item)[window]
    items = phrases.items[textkit.gather_ranges(phrases.first_item[window], per)]
    pairs = np.unique(np.stack([np.repeat(text_of(first), per), items], axis=1), axis=0) if len(window) else np.zeros((0, 2), np.int64)
    return Found(w, np.stack([text_of(a), a, b], axis=1), pairs)


def pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text): benchmark with texts above `most` bytes cut at words into overlapping pieces that have the same windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                if len(raw) <= most:
                    ids.append(i)
                    parts.append(text)
                    continue
                data = np.frombuffer(raw, np.uint8)
                w = textkit.words_of(data, np.array([0, len(data)]), textkit.alnum_words())
                n, a = len(w.starts), 0
                while a < n:
                    b = min(n, max(a + window, int(np.searchsorted(w.ends, w.starts[a] + most, "right"))))
                    ids.append(i)
                    parts.append(raw[w.starts[a] : w.ends[b - 1]].decode())
                    a = n if b == n else b - window + 1
            for k in range(0, len(ids), 64):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 64], batch.schema.field("item_id").type), pa.array(parts[k : k + 64], pa.string())], ["item_id", "text"])

    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, rows.schema)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Phrases, bool]]:
    """(compiled phrases, whether more blocks follow); a block holds about block_bytes of text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    rows = benchmark.select("item_id", "text")
    if n > 1:
        rows = materialise(pieces(rows, window, max(1, block_bytes // 8)), "benchmark-pieces")
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = part.collect()  # about block_bytes
        yield compile_phrases([r[0] for r in found], [r[1] for r in found], window), k + 1 < n


_SPAN = "array<struct<start:int,end:int>>"
_ITEMS, _STATE = "dc_items", "dc_spans"


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """docs with dc_items (names), dc_spans (merged hit spans by word numbers), dc_words, dc_hit and dc_cut (the spans by code points)."""
    spark = docs.sparkSession
    tune(spark)
    extra = T._parse_datatype_string(f"{_ITEMS} array<string>, {_STATE} {_SPAN}, dc_words long, dc_hit long, dc_cut {_SPAN}")
    names = list(docs.columns)
    out = docs
    schema = T.StructType([*docs.schema.fields, *extra.fields])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for k, (compiled, more) in enumerate(_blocks(benchmark, window, block_bytes)):
        sent = spark.sparkContext.broadcast(compiled)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, again=k > 0) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for batch in batches:
                n = batch.num_rows
                items = batch.column(_ITEMS).to_pylist() if again else [[] for _ in range(n)]
                before = batch.column(_STATE).to_pylist() if again else None
                spans, cuts = [[] for _ in range(n)], [[] for _ in range(n)]
                n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for lo, hi, data, offsets in textkit.slices(batch.column("text")):
                    earlier = []
                    if again and any(before[lo:hi]):
                        first = textkit.words_of(data, offsets, textkit.alnum_words()).first
                        earlier = [(int(first[i]) + s["start"], int(first[i]) + s["end"]) for i in range(hi - lo) for s in before[lo + i]]
                    found = hits(phrases, data, offsets, earlier)
                    w = found.words
                    n_words[lo:hi] = w.counts
                    if len(found.spans):
                        points = textkit.codepoints_before(data)
                        for row, a, b in found.spans.tolist():
                            base = points[offsets[row]]
                            spans[lo + row].append({"start": a - int(w.first[row]), "end": b - int(w.first[row])})
                            cuts[lo + row].append({"start": int(points[w.starts[a]] - base), "end": int(points[w.ends[b - 1]] - base)})
                            n_hit[lo + row] += b - a
                    for row, item in found.items.tolist():
                        items[lo + row].append(phrases.names[item])
                items = [sorted(set(x)) for x in items]
                own = [batch.column(i) for i in range(len(names))]  # by place: names may repeat
                made = [pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type), pa.array(n_words), pa.array(n_hit), pa.array(cuts, span_type)]
                yield pa.RecordBatch.from_arrays([*own, *made], [*names, _ITEMS, _STATE, "dc_words", "dc_hit", "dc_cut"])

        out = out.mapInArrow(scan, schema)
        if more:  # a block's phrases leave driver and workers before the next are made
            out = materialise(out, "decontamination-block")
            sent.destroy()
            del compiled
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted names) and cuts (merged spans by code points) of every document."""
    found = _scanned(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return found.select("doc_id", F.col("dc_words").alias("n_words"), F.col("dc_hit").alias("n_hit"), F.col(_ITEMS).alias("items"), F.col("dc_cut").alias("cuts"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit spans cut out of text (and n_chars, if there, counted anew); texts without a hit stay as they are."""
    found = _scanned(docs, benchmark, window, block_bytes)
    text = F.col("text")
    pieces = F.transform(
        F.col("dc_cut"),
        lambda s, i: F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("dc_cut"), i)["end"]) + 1, s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("dc_cut"), i)["end"])),
    )
    last = F.substring(text, F.element_at(F.col("dc_cut"), -1)["end"] + 1, F.length(text))
    cut = F.when(F.size("dc_cut") > 0, F.concat(F.concat_ws("", pieces), last)).otherwise(text)
    found = found.withColumn("text", cut)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("dc_cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def reference_digest(text: str | None, items: list[tuple], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """Brute force for one document, for tests."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                found.add("null" if name is None else str(name))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
