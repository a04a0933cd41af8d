import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import textkit, token_output
from tessera.llm.queries import op7_token_output
from tessera.llm.shared import scratch, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


ENCODER = token_output.Encoder(tokenizer_path())


def encoded(texts, most=textkit.SLICE_BYTES):
    out = []
    for _, _, data, offsets in textkit.slices(pa.array(texts, pa.string()), most):
        ids, counts = ENCODER.encode(data, offsets)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab's 1 \n\t\r\x0b  \u0085　\x1c.!é😀<|endoftext|>"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_whole_texts(texts):
    whole = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(texts) == whole
    assert encoded(texts, 5) == whole


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"some words {i} and {i * 7} more\nlines of text {i % 5}" for i in range(200)]
    whole = encoded(texts)
    monkeypatch.setattr(token_output, "REMEMBERED", 20)
    assert encoded(texts, 100) == whole


def test_pieces_with_equal_hashes_keep_their_own_ids(monkeypatch):
    texts = [f"piece{i} of{i % 3} ab{'c' * (i % 4)} x{i % 2}" for i in range(60)]
    whole = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    real = textkit.span_hashes
    ENCODER._forget()
    monkeypatch.setattr(textkit, "span_hashes", lambda *a, **k: real(*a, **k) % np.uint64(7))
    try:
        assert encoded(texts) == whole and encoded(texts, 40) == whole
    finally:
        ENCODER._forget()


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_regular_words_keep_their_own_ids(letters):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(letters))
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    assert encoded(texts) == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_index_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n)) if n > 3 else np.arange(n)
    ids = np.arange(2 * len(keys), dtype=np.uint16)
    shard = token_output.Shard(token_output.pack_shard(keys, np.zeros(len(keys), bool), np.full(len(keys), 2), ids, 2))
    assert (np.sort(shard.first) == np.arange(len(keys))).all()
    for i in range(0, len(keys), max(1, len(keys) // 50)):
        assert shard.ids_of(int(keys[i])).tolist() == [2 * i % 65536, (2 * i + 1) % 65536]
    assert shard.ids_of(2**62 + 5) is None


def test_rows(make, clashing, odd_rows, tokenizer):
    docs = clashing(make(odd_rows), "path", "base", "n_ids")
    got = token_output.token_output(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6]
    at = 0
    for r, (_, text) in zip(got, sorted(odd_rows, key=lambda x: (x[0] is not None, x[0])), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_many_shards_and_keyed_access(spark, make, tokenizer):
    docs = make([(i, f"document number {i} has {i * i} in it") for i in range(300)])
    manifest = token_output.write_shards(docs, scratch(spark, "t"), tokenizer_path(), shard_tokens=200)
    shards = [token_output.read_shard(r["path"]) for r in manifest.orderBy("part", "seq").collect()]
    assert len(shards) > 8 and sum(len(s.keys) for s in shards) == 300
    for i in (0, 17, 299):
        (ids,) = [x for s in shards if (x := s.ids_of(i)) is not None]
        assert ids.tolist() == [*tokenizer.encode(f"document number {i} has {i * i} in it", add_special_tokens=False).ids, 2]
        assert token_output.lookup(manifest, i).tolist() == ids.tolist()
    for absent in (-1, 300, 2**40):
        assert token_output.lookup(manifest, absent) is None
    path = manifest.orderBy("part", "seq").first()["path"]
    shelf = token_output.Shelf(path)
    found = shelf.ids_of(0)
    assert shelf.bytes_read == token_output._HEADER.size + 4 + 4 + 4 + 8 + 16 + found.nbytes
    starts = token_output.read_back(manifest).orderBy("doc_id").collect()
    assert [r["start"] for r in starts] == np.cumsum([0, *[r["n_tokens"] for r in starts]])[:-1].tolist()


def test_copies_of_one_row_and_null_keys(spark, make):
    docs = make([(7, "the same text again")] * 400 + [(None, "no key")] * 300).repartition(6)
    manifest = token_output.write_shards(docs, scratch(spark, "t"), tokenizer_path(), shard_tokens=500)
    assert manifest.where("n_docs > 0").select("part").distinct().count() > 2
    got = token_output.read_back(manifest)
    assert got.where("doc_id = 7").count() == 400 and got.where("doc_id is null").count() == 300
    assert token_output.lookup(manifest, 7).tolist() == encoded(["the same text again"])[0] + [2]


def test_empty(make):
    assert token_output.token_output(make([])).count() == 0


def test_query_against_brute_force(spark, small, tokenizer):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in op7_token_output(spark, small).collect()}
    at = 0
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def whole(texts):
    return [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def pieces_of(*texts):
    data, offsets = textkit.buffers(pa.array(texts, pa.string()))
    return [x.tobytes().decode() for x in np.split(data, token_output.piece_starts(data, offsets)[1:])]


@pytest.mark.parametrize("texts", [["a\n\n", "b"], ["a \n\n", "", ".b"], ["a\n\n<|endoftext|>b"], ["é\n\n\n\n<|endoftext|>", "<|endoftext|>"]])
def test_white_space_before_the_end_of_a_text_or_section(texts):
    assert encoded(texts) == whole(texts)


def test_words_are_one_piece_with_and_without_marks():
    assert pieces_of("to be, to be. (be) été;", ".be") == ["to", " be", ",", " to", " be", ".", " (be", ")", " été", ";", ".be"]
    assert pieces_of("a×. 字, b") == ["a×.", " 字,", " b"]


PARTS = "'s|'ll|'|''|don't|l'été|×|÷|é|ñ×ñ|ł.|ſ,|….|€5.|.|,|$$$| |  |\n|\n\n|\t|\r\n|\u0085|　| .|\x1c|\x1f.|ŉ'|ǅ,|ª.|µ;|Α.|字.|1|3.14|1a.|word|Word|😀.|a_b|--|\x00|\x7f.|Ã—|Ã·|é÷!|endoftext|<".split("|") + ["<|endoftext|>", "a<|endoftext|>b", "|>", "<|", "a" * 70]


def test_odd_characters_beside_each_other(monkeypatch):
    rng = np.random.default_rng(3)
    for most, remembered in ((1 << 20, 10**6), (40, 50), (5, 10)):
        monkeypatch.setattr(token_output, "REMEMBERED", remembered)
        for _ in range(60):
            texts = ["".join(PARTS[i] for i in rng.integers(0, len(PARTS), n)) for n in rng.integers(0, 9, 12)]
            assert encoded(texts, most) == whole(texts)


def test_pieces_with_equal_wide_hashes_keep_their_own_ids(monkeypatch):
    texts = [f"piece{i} of{i % 3} ab{'c' * (i % 4)} x{i % 2} {'long' * 20}{i % 5} {'d' * (60 + i % 9)}" for i in range(60)]
    real = textkit.wide_hashes
    ENCODER._forget()
    monkeypatch.setattr(textkit, "wide_hashes", lambda *a: real(*a) % np.uint64(7))
    try:
        assert encoded(texts) == whole(texts) and encoded(texts, 40) == whole(texts)
    finally:
        ENCODER._forget()


def test_common_pieces_outlast_a_full_memory(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 60)
    ENCODER._forget()
    asked = []
    real = ENCODER._ids_of
    monkeypatch.setattr(ENCODER, "_ids_of", lambda data, starts, sizes: asked.extend(data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)) or real(data, starts, sizes))
    texts = [f"the common words {'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}q" for i in range(400)]
    assert encoded(texts, 60) == whole(texts)
    assert asked.count(b" common") == 1 and len(asked) == 403


def test_what_is_no_utf8():
    raw = [b"caf\xc3 x\xe9t\xc3\xa9, \x80\xbf.", b"\xc3", b"\x97. \xc3\xa9.", b"word"]
    column = pa.array(raw, pa.binary()).view(pa.string())
    ids, counts = ENCODER.encode(*textkit.buffers(column))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole([x.decode("utf-8", "replace") for x in raw])
