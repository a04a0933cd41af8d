"""Words and their hashes for whole Arrow batches, without a Python object per word.

A batch's texts lie in one byte buffer. Word borders come from a table lookup per byte. A word's 64-bit hash is tabulation hashing: each byte
is replaced by a random 64-bit number that belongs to the byte and its place in the word, and these are added up and finalised, so the cost is a
few array passes over the bytes. Hashes of equal words are equal everywhere. As the numbers are independent of each other and of the texts, two
different words, however alike or regular, collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes (a longer text makes a slice of its own).
SLICE_BYTES = 2 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Random numbers by place in a word and byte; later places mix the first row's numbers with the place.
PLACES = 64
_TABLE = np.random.default_rng(0x7E55E8A).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64).reshape(-1)


def space_words() -> np.ndarray:
    """Word bytes of [^\\x20\\x09-\\x0D]+ ."""
    lut = np.ones(256, bool)
    lut[[0x20, *range(0x09, 0x0E)]] = False
    return lut


def alnum_words() -> np.ndarray:
    """Word bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z went to lower case."""
    lut = np.zeros(256, bool)
    lut[0x30:0x3A] = lut[0x61:0x7B] = lut[0x41:0x5B] = lut[0x80:] = True
    return lut


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; makes every bit depend on all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; an empty span's is that of no bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = gather_ranges(starts, lengths)
    last = np.cumsum(lengths)
    place = np.arange(len(at)) - np.repeat(last - lengths, lengths)
    value = LOWER[data[at]] if lower else data[at]
    random = _TABLE[(np.minimum(place, PLACES - 1) << 8) | value]
    if int(lengths.max()) >= PLACES:
        far = np.flatnonzero(place >= PLACES - 1)
        random[far] = mix(_TABLE[value[far]] ^ mix(place[far].astype(np.uint64) * _GOLD))
    sums = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(random, out=sums[1:])
    return mix(sums[last] - sums[last - lengths] + lengths.astype(np.uint64) * _GOLD)


#: Spans of more bytes are hashed and compared byte by byte.
WIDE_BYTES = 64
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def wide(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def eight_bytes(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each span as one number, zeros behind its end; every span must have a byte there. view: wide(data)."""
    return view[starts + 8 * k] & _LOW[np.minimum(sizes - 8 * k, 8)]


def wide_hashes(data: np.ndarray, view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty spans, eight bytes at a time. For those who compare the bytes of equal hashes: texts may be made to collide."""
    out = mix(eight_bytes(view, starts, sizes, 0) ^ (sizes.astype(np.uint64) * _GOLD))
    more, k = np.flatnonzero((sizes > 8) & (sizes <= WIDE_BYTES)), 1
    while len(more):
        out[more] = mix((out[more] + _GOLD) ^ eight_bytes(view, starts[more], sizes[more], k))
        k += 1
        more = more[sizes[more] > 8 * k]
    far = np.flatnonzero(sizes > WIDE_BYTES)
    out[far] = span_hashes(data, starts[far], starts[far] + sizes[far], lower=False)
    return out


@dataclass
class Words:
    """Words of some texts: their byte borders in data, the first word of each text, and the texts' byte borders."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1 entries

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def words_of(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> Words:
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, offsets, empty, empty, np.zeros(len(offsets), np.int64))
    inside = lut[data]
    full = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[full] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[full[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `most` bytes."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def codepoints_before(data: np.ndarray) -> np.ndarray:
    """Number of code points that start before each byte, len(data) + 1 entries."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
