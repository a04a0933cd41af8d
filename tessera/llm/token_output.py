"""Token ids as binary files with a minimal perfect hash index.

Encoding. Texts are cut where the byte-level pre-tokenizer can not look across: before a white-space character that a
non-white-space one follows, behind it unless it is a plain space (a plain space goes with the word behind it), and between a letter and a
punctuation mark. Each distinct piece is encoded once by the tokenizers library and kept in a hash table, so common words cost an array lookup.
Every piece's bytes are compared with those kept under its hash, and pieces that differ are encoded by themselves. Pieces that are one word
go to the library's BPE model in the byte-level alphabet, without the pre-tokenizer. The ids are those of the whole text.

Files. Documents go out in ascending key order (range-partitioned), in shards of at most SHARD_TOKENS ids or one document.
A shard holds a header, the keys, the documents' offsets, the index and the raw ids (2 bytes each where the vocabulary allows).
The index is a hash-and-displace minimal perfect hash: keys fall into buckets, and each bucket stores the displacement that sends
its keys to free slots; a slot stores a 32-bit fingerprint and the number of its document in the shard. The manifest holds each shard's range of
keys, which leads a key to its shard; lookup() then reads the header, one displacement, one slot, the key, two offsets and the document's ids by
range reads, whatever the shard's size. Shards are written under new names, and only those that finished tasks name in the manifest are read, so a
lost executor or a repeated task leaves no wrong file in use.

Defined results: a null or empty text has only the end id; null keys come first and are not in the index; rows with equal keys follow each
other, and a lookup gives the first of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.shared import materialise, scratch, shuffle_partitions, tokenizer_path, tune

END_ID = 2
#: Ids of a shard at most (but for a single longer document): 16 MB at 2 bytes.
SHARD_TOKENS = 8_000_000
#: Pieces that a worker remembers at most: about 100 MB.
REMEMBERED = 1_200_000
MAGIC = b"TESSIDS1"
_HEADER = struct.Struct("<8sBxxxIQQQ")  # magic, bytes of an id, buckets, documents, indexed keys, ids

#: Classes of bytes, as bits. SURE is no white space to any engine; a C2, E1, E2 or E3 may start such a character of more than one byte.
_SPACE, _SURE, _BREAK, _LETTER, _MARK, _LEAD, _INNER = (1 << k for k in range(7))
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KINDS[range(0x09, 0x0E)] |= _BREAK
_KINDS[[b for b in range(256) if b not in (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3)]] |= _SURE
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_KINDS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] |= _MARK
#: U+00C0 to U+017F, which are letters but for the signs of multiplication and division (C3 97, C3 B7).
_KINDS[[0xC3, 0xC4, 0xC5]] |= _LEAD
_KINDS[range(0x80, 0xC0)] |= _INNER


def _signs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where two bytes are one of the signs among the letters."""
    return (first == 0xC3) & ((second == 0x97) | (second == 0xB7))


def piece_starts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = _KINDS) -> np.ndarray:
    """Byte positions where a piece begins; every non-empty text begins one. Texts do not look at each other."""
    if not len(data):
        return np.zeros(0, np.int64)
    full = np.diff(offsets) > 0
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    kind = kinds[data]
    follows = np.zeros(len(data), np.uint8)  # a white-space byte with a safe non-white-space byte behind it
    follows[:-1] = kind[:-1] & (kind[1:] >> 1) & 1
    follows[last] = 0
    cut = follows.copy()
    cut[1:] |= follows[:-1] & (kind[:-1] >> 2)
    kind[first] &= ~np.uint8(_INNER)
    marks = np.flatnonzero((kind & _MARK) > 0)
    marks = marks[marks > 0]
    before, lead = kind[marks - 1], np.maximum(marks - 2, 0)
    two = ((before & _INNER) > 0) & ((kind[lead] & _LEAD) > 0) & ~_signs(data[lead], data[marks - 1])
    cut[marks[((before & _LETTER) > 0) | two]] = 1
    cut[first] = 1
    return np.flatnonzero(cut.view(bool))


def _alphabet() -> np.ndarray:
    """The character of each byte in the byte-level alphabet."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u4")
    out[shown] = shown
    hidden = [b for b in range(256) if b not in set(shown)]
    out[hidden] = np.arange(256, 256 + len(hidden))
    return out


_ALPHABET = _alphabet()
#: Words that go to the model in one call.
RUN = 1000


class Encoder:
    """Ids of whole texts, by distinct pieces. What is known of a piece is kept under its number, and its number in an open hash table."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each Spark task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        #: Bytes that an id stands for: the byte-level alphabet has one character a byte.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        spec = json.loads(self.tokenizer.to_str())
        added, level, self.kinds, self.words = spec["added_tokens"], spec["pre_tokenizer"] or {}, _KINDS.copy(), None
        for a, b in (x for token in added for x in zip(token["content"].encode(), token["content"].encode()[1:])):
            if not _KINDS[b] & _SPACE and _KINDS[a] & (_LETTER | _INNER):  # no cut inside an added token
                self.kinds[b] &= ~np.uint8(_MARK)
        self.kinds[[token["content"].encode()[0] for token in added]] &= ~np.uint8(_SURE)  # white space before an added token ends a section, as at a text's end
        if any(token["single_word"] for token in added):  # these look at their neighbours
            self.kinds &= ~np.uint8(_MARK)
        plain = spec["model"]["type"] == "BPE" and not spec["normalizer"] and level.get("type") == "ByteLevel" and not level["add_prefix_space"] and level.get("use_regex", True)
        if plain and all((_KINDS[list(token["content"].encode())] & _MARK).any() for token in added):  # no word holds an added token
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self._forget()

    def _forget(self) -> None:
        self.known, self.used, self.filled, self.now = 0, 0, 0, 0
        self.table = np.full(1 << 12, -1, np.int32)
        self.keys, self.first, self.at = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.lengths, self.sizes, self.born, self.seen = (np.zeros(1 << 10, np.int32) for _ in range(4))
        self.flat = np.zeros(1 << 12, np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32)
        self.raw = np.zeros(1 << 12, np.uint64)  # the pieces' bytes, each from a new number on

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into an array that grows by a quarter."""
        array = getattr(self, name)
        if at + len(values) > len(array):
            more = np.zeros(max(len(array) * 5 // 4, at + len(values)), array.dtype)
            more[:at] = array[:at]
            setattr(self, name, array := more)
        array[at : at + len(values)] = values

    def _enter(self, numbers: np.ndarray) -> None:
        """Enter known pieces, of distinct hashes, into the table."""
        mask = len(self.table) - 1
        place = (self.keys[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.table[place] < 0
            self.table[place[free]] = numbers[free]
            left = self.table[place] != numbers
            numbers, place = numbers[left], (place[left] + 1) & mask

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's piece; -1 where none is known."""
        mask = len(self.table) - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        number = self.table[place]
        left = np.flatnonzero((number >= 0) & (self.keys[number] != hashes))
        while len(left):
            place[left] = (place[left] + 1) & mask
            number[left] = found = self.table[place[left]]
            left = left[(found >= 0) & (self.keys[found] != hashes[left])]
        return number

    def _keep_used(self) -> None:
        """Forget the pieces that no slice after their first one held, and of the others all but the REMEMBERED / 2 that were met last."""
        keep = np.flatnonzero(self.seen[: self.known] > self.born[: self.known])
        if len(keep) > (most := REMEMBERED // 2):
            keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[:most]])
        now, sizes, lengths = self.now, self.sizes[keep], self.lengths[keep]
        kept = self.keys[keep], sizes, lengths, self.flat[textkit.gather_ranges(self.first[keep], lengths)], self.raw[textkit.gather_ranges(self.at[keep], (sizes + 7) // 8)]
        self._forget()
        self.now = now
        self._append(*kept)

    def _append(self, keys: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, whose ids and bytes follow each other."""
        n, wide = self.known, (sizes.astype(np.int64) + 7) // 8
        self._put("flat", self.used, ids)
        self._put("raw", self.filled, raw)
        many = lengths.astype(np.int64)
        fresh = np.full(len(keys), self.now)
        for name, values in (("keys", keys), ("sizes", sizes), ("lengths", lengths), ("first", self.used + np.cumsum(many) - many), ("at", self.filled + np.cumsum(wide) - wide), ("born", fresh), ("seen", fresh)):
            self._put(name, n, values)
        self.known, self.used, self.filled = n + len(keys), self.used + len(ids), self.filled + len(raw)
        numbers = np.arange(n, self.known, dtype=np.int32)
        if 3 * self.known > len(self.table):
            self.table = np.full(1 << (4 * self.known).bit_length(), -1, np.int32)
            self._enter(np.arange(self.known, dtype=np.int32))
        else:
            self._enter(numbers)
        return numbers

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece). Pieces that begin with a plain space keep their ids when they are joined, so they go in long runs."""
        joined = [i for i, p in enumerate(pieces) if p[0] == 0x20 and len(p) > 1 and p[-1] > 0x20]
        alone = sorted(set(range(len(pieces))).difference(joined))
        found: list = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for run in (joined[lo : lo + RUN] for lo in range(0, len(joined), RUN)):
            ids = self.tokenizer.encode_batch_fast([b"".join([pieces[i] for i in run]).decode("utf-8", "replace")], add_special_tokens=False)[0].ids
            at = self._borders(np.array(ids, np.int64), sizes[run])
            if at is None:
                alone += run
                continue
            for i, lo, hi in zip(run, [0, *at.tolist()], at.tolist()):
                found[i] = ids[lo:hi]
        for i, x in zip(alone, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in alone], add_special_tokens=False), strict=True):
            found[i] = x.ids
        return np.array([x for part in found for x in part], np.uint32), np.array([len(x) for x in found], np.int64)

    def _borders(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
        """How many ids reach to the end of each of the joined pieces; None if an id lies across an end."""
        covered, ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])]), np.cumsum(sizes)
        at = np.searchsorted(covered, ends)
        return at if covered[-1] == ends[-1] and (covered[at] == ends).all() else None

    def _plain_words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each piece is letters only, but for a plain space before them: the pre-tokenizer leaves it whole."""
        if self.words is None:
            return np.zeros(len(starts), bool)
        raw, begins = data[textkit.gather_ranges(starts, sizes)], np.cumsum(sizes) - sizes
        other = (_KINDS[raw] & (_LETTER | _LEAD | _INNER)) == 0
        other[:-1] |= _signs(raw[:-1], raw[1:])
        other[begins[(raw[begins] == 0x20) & (sizes > 1)]] = False
        words = np.bitwise_or.reduceat(other, begins) == 0
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:  # what is no UTF-8 goes through the tokenizer, which sees other characters
            words &= np.bitwise_or.reduceat(raw, begins) < 0x80
        return words

    def _encoded_words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of ids) of plain words; None if an id lies across two of them."""
        ends = np.cumsum(sizes + 1)
        letters = _ALPHABET[np.append(data, np.uint8(0))[textkit.gather_ranges(starts, sizes + 1)]]
        letters[ends - 1] = 0x0A
        text, ids = letters.tobytes().decode("utf-32-le"), []
        for lo in range(0, len(starts), RUN):
            run = text[ends[lo] - sizes[lo] - 1 : ends[min(lo + RUN, len(ends)) - 1]]
            ids.append(np.array(self.words.encode_batch_fast([run], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(ids)
        at = self._borders(ids, sizes)
        return None if at is None else (ids, np.diff(at, prepend=0))

    def _ids_of(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece), from the library."""
        words = self._plain_words(data, starts, sizes)
        first, lengths, ids, done = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [], 0
        for which in (np.flatnonzero(words), np.flatnonzero(~words)):
            if len(which):
                found = self._encoded_words(data, starts[which], sizes[which]) if words[which[0]] else None
                part, own = found or self._encoded([data[a : a + n].tobytes() for a, n in zip(starts[which].tolist(), sizes[which].tolist(), strict=True)])
                lengths[which], first[which] = own, done + np.cumsum(own) - own
                ids.append(part)
                done += len(part)
        return np.concatenate(ids)[textkit.gather_ranges(first, lengths)], lengths

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of pieces that become known."""
        ids, lengths = self._ids_of(data, starts, sizes)
        wide = (sizes + 7) // 8
        raw = np.zeros(8 * int(wide.sum()), np.uint8)
        raw[textkit.gather_ranges(8 * (np.cumsum(wide) - wide), sizes)] = data[textkit.gather_ranges(starts, sizes)]
        return self._append(keys, sizes, lengths, ids, raw.view("<u8"))

    def _strangers(self, data: np.ndarray, view: np.ndarray, starts: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which pieces' bytes are not those kept under their number."""
        at = self.at[number]
        other = (self.sizes[number] != sizes) | (self.raw[at] != textkit.eight_bytes(view, starts, sizes, 0))
        more, k = np.flatnonzero((sizes > 8) & (sizes <= textkit.WIDE_BYTES) & ~other), 1
        while len(more):
            other[more] = self.raw[at[more] + k] != textkit.eight_bytes(view, starts[more], sizes[more], k)
            k += 1
            more = more[sizes[more] > 8 * k]
            more = more[~other[more]]
        far = np.flatnonzero((sizes > textkit.WIDE_BYTES) & ~other)
        if len(far):
            same = self.raw.view(np.uint8)[textkit.gather_ranges(8 * at[far], sizes[far])] == data[textkit.gather_ranges(starts[far], sizes[far])]
            other[far] = ~np.logical_and.reduceat(same, np.cumsum(sizes[far]) - sizes[far])
        return np.flatnonzero(other)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        starts = piece_starts(data, offsets, self.kinds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        sizes, view = np.diff(starts, append=len(data)), textkit.wide(data)
        hashes = textkit.wide_hashes(data, view, starts, sizes)
        self.now += 1
        number = self._find(hashes)
        new = np.flatnonzero(number < 0)
        if self.known + len(new) > REMEMBERED:  # each piece counts as often as it occurs: at most too early
            self._keep_used()
            number = self._find(hashes)
            new = np.flatnonzero(number < 0)
        if len(new):
            unique, where, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            number[new] = self._learn(data, starts[new[where]], sizes[new[where]], unique)[inverse]
        self.seen[number] = self.now
        lengths = self.lengths[number].astype(np.int64)
        ids = self.flat[textkit.gather_ranges(self.first[number], lengths)]
        others = self._strangers(data, view, starts, sizes, number)
        if len(others):
            own, many = self._ids_of(data, starts[others], sizes[others])
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i, x in zip(others.tolist(), np.split(own, np.cumsum(many)[:-1]), strict=True):
                parts[i] = x
            ids, lengths = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        done = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(done[np.searchsorted(starts, offsets)])


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """A worker's encoder: it lives as long as the worker, so that later tasks know the common pieces."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# Index ---------------------------------------------------------------------------------------------------------------


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, slot hash, slot step and fingerprint of each key."""
    x = textkit.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    y = textkit.mix(x + np.uint64(0x9E3779B97F4A7C15))
    return x >> np.uint64(32), y & np.uint64(0xFFFFFFFF), (y >> np.uint64(32)) | np.uint64(1), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _slots(displacement: np.ndarray, hashed: np.ndarray, step: np.ndarray, n: int) -> np.ndarray:
    """Negative displacements name a slot; others move the key along its own steps."""
    d = np.maximum(displacement, 0).astype(np.uint64)
    moved = textkit.mix(hashed + d * step) % np.uint64(n)
    return np.where(displacement < 0, -displacement - 1, moved.astype(np.int64))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacement of each bucket, fingerprint of each slot, number of each slot's key) for distinct keys."""
    n = len(keys)
    buckets = max(1, (n + 2) // 3)
    if not n:
        return np.zeros(1, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    pick, hashed, step, prints = _hashes(keys)
    bucket = (pick % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    displacement = np.zeros(buckets, np.int32)
    taken = np.zeros(n, bool)
    number = np.zeros(n, np.uint32)
    tries = np.arange(256, dtype=np.uint64)[:, None]
    for b in np.argsort(-sizes, kind="stable"):
        size = int(sizes[b])
        if size < 2:
            break
        own = order[ends[b] - size : ends[b]]
        base = 0
        while True:
            slots = (textkit.mix(hashed[own][None, :] + (tries + np.uint64(base)) * step[own][None, :]) % np.uint64(n)).astype(np.int64)
            good = ~taken[slots].any(axis=1)
            ranked = np.sort(slots, axis=1)
            good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                displacement[b], taken[slots[k]], number[slots[k]] = base + k, True, own
                break
            base += 256
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    own = order[ends[single] - 1]
    displacement[single] = -free[: len(single)] - 1
    number[free[: len(single)]] = own
    return displacement, prints[number], number


# Shards --------------------------------------------------------------------------------------------------------------


def pack_shard(keys: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A shard's bytes. keys ascend, null ones come first; counts are the documents' numbers of ids."""
    known = np.flatnonzero(~null)
    distinct, at = np.unique(keys[known], return_index=True)
    displacement, prints, number = build_index(distinct)
    first = known[at][number].astype(np.uint32) if len(distinct) else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    parts = [_HEADER.pack(MAGIC, width, len(displacement), len(keys), len(distinct), len(ids)), keys.astype("<i8"), null.astype("u1"), starts, displacement.astype("<i4"), prints.astype("<u4"), first.astype("<u4"), ids.astype(f"<u{width}")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A shard that was read; ids_of() looks a key up."""

    def __init__(self, raw: bytes):
        magic, width, buckets, docs, indexed, ids = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.null, self.starts = take("<i8", docs), take("u1", docs).astype(bool), take("<u8", docs + 1).astype(np.int64)
        self.displacement, self.prints, self.first, self.ids = take("<i4", buckets), take("<u4", indexed), take("<u4", indexed), take(f"<u{width}", ids)

    def numbers_of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's first document in the shard; -1 where the fingerprint says that it has none."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        pick, hashed, step, prints = _hashes(keys)
        slot = _slots(self.displacement[(pick % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64), hashed, step, len(self.prints))
        return np.where(self.prints[slot] == prints, self.first[slot].astype(np.int64), -1)

    def ids_of(self, key: int) -> np.ndarray | None:
        """The ids of a key's first document."""
        n = int(self.numbers_of(np.array([key], np.int64))[0])
        return None if n < 0 or self.keys[n] != key else self.ids[self.starts[n] : self.starts[n + 1]]


def read_shard(path: str) -> Shard:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return Shard(f.read())


class Shelf:
    """A shard's file, read by ranges only: `bytes_read` counts what a lookup costs."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file, self.bytes_read = fs.open_input_file(at), 0
        magic, self.width, self.buckets, self.docs, self.indexed, self.n_ids = _HEADER.unpack(self._bytes(0, _HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.keys_at = _HEADER.size
        self.starts_at = self.keys_at + 9 * self.docs
        self.displacement_at = self.starts_at + 8 * (self.docs + 1)
        self.prints_at = self.displacement_at + 4 * self.buckets
        self.first_at = self.prints_at + 4 * self.indexed
        self.ids_at = self.first_at + 4 * self.indexed

    def _bytes(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, at)

    def _number(self, at: int, kind: str) -> int:
        return int(np.frombuffer(self._bytes(at, np.dtype(kind).itemsize), kind)[0])

    def ids_of(self, key: int) -> np.ndarray | None:
        """The ids of a key's first document."""
        if not self.indexed:
            return None
        pick, hashed, step, prints = _hashes(np.array([key], np.int64))
        displacement = self._number(self.displacement_at + 4 * int(pick[0] % np.uint64(self.buckets)), "<i4")
        slot = int(_slots(np.array([displacement]), hashed, step, self.indexed)[0])
        if self._number(self.prints_at + 4 * slot, "<u4") != int(prints[0]):
            return None
        n = self._number(self.first_at + 4 * slot, "<u4")
        if self._number(self.keys_at + 8 * n, "<i8") != key:
            return None
        a, b = np.frombuffer(self._bytes(self.starts_at + 8 * n, 16), "<u8").tolist()
        return np.frombuffer(self._bytes(self.ids_at + a * self.width, (b - a) * self.width), f"<u{self.width}")


def lookup(manifest: DataFrame, key: int) -> np.ndarray | None:
    """The ids of a key's first document, or None. Reads one row of the manifest and a few ranges of one shard."""
    row = manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part", "seq").select("path").first()
    return Shelf(row["path"]).ids_of(key) if row else None


_MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, first_key long, last_key long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs' texts and write the shards; returns the manifest, a row per shard, as a table that is written itself."""
    spark = docs.sparkSession
    tune(spark)
    n = max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("row", F.monotonically_increasing_id())  # splits copies of one row
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "row")
        .drop("row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        encoder, part, seq, held = encoder_for(vocabulary), TaskContext.get().partitionId(), 0, 0
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        kept: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            keys, null, counts, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
            name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(pack_shard(keys, null, counts, ids, width))
            known = keys[~null]
            row = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                    "first_key": pa.array(known[:1].tolist() or [None], pa.int64()), "last_key": pa.array(known[-1:].tolist() or [None], pa.int64()),
                }
            )
            seq, held = seq + 1, 0
            kept.clear()
            return row

        for batch in batches:
            column = batch.column("doc_id")
            null = np.asarray(column.is_null())
            keys = np.asarray(column.fill_null(0)).astype(np.int64)
            for lo, hi, data, offsets in textkit.slices(batch.column("text"), min(1 << 20, shard_tokens)):  # a text has no more ids than bytes
                ids, counts = encoder.encode(data, offsets)
                to = np.cumsum(counts)
                ids = np.insert(ids, to, end_id)
                if held and held + len(ids) > shard_tokens:
                    yield flush()
                kept.append((keys[lo:hi], null[lo:hi], counts + 1, ids.astype(f"u{width}")))
                held += len(ids)
        if kept:
            yield flush()

    return materialise(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


_RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, payload_bytes long"


def read_back(manifest: DataFrame) -> DataFrame:
    """A row per document from the files: every document with a key is looked up through the index."""
    spark = manifest.sparkSession
    # a row per shard, not per document
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = read_shard(path)
                at = np.arange(len(shard.keys))
                found = shard.numbers_of(shard.keys)
                same = at - found  # copies of a key follow its first document
                if ((found < 0) | (same < 0) | (shard.keys[np.maximum(found, 0)] != shard.keys))[~shard.null].any():
                    raise ValueError(f"{path}: the index does not lead to a key's document")
                starts = shard.starts
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.keys, mask=shard.null), "start": pa.array(starts[:-1] + base), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(crc, pa.int64()), "payload_bytes": pa.array(np.diff(starts) * shard.ids.itemsize)})

    return placed.select("path", "base").repartition(shuffle_partitions(spark)).mapInArrow(read, _RESULT)


def token_output(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """Write docs' token shards to the shared folder and return what the files hold."""
    folder = folder or scratch(docs.sparkSession, "token-shards")
    return read_back(write_shards(docs, folder, vocabulary or tokenizer_path()))
