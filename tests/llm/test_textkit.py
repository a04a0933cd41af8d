import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import textkit

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n\r\v\f.é😀\x00\x1c ", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_are_those_of_the_patterns(texts, most):
    for lut, pattern in ((textkit.space_words(), r"[^\x20\x09-\x0D]+"), (textkit.alnum_words(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        rows = 0
        for lo, hi, data, offsets in textkit.slices(pa.array(texts, pa.string()), most):
            w = textkit.words_of(data, offsets, lut)
            hashes = w.hashes()
            for i in range(hi - lo):
                low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[lo + i] or "")
                want = [x.encode() for x in re.findall(pattern, low)]
                at = range(w.first[i], w.first[i + 1])
                assert [w.word(k) for k in at] == want
                for k, word in zip(at, want, strict=True):
                    assert seen.setdefault(word, hashes[k]) == hashes[k]
            rows += hi - lo
        assert rows == len(texts)
        assert len(set(seen.values())) == len(seen)


def test_slices_of_a_sliced_column():
    column = pa.array(["a", "bb", None, "cc d"]).slice(1, 3)
    (part,) = textkit.slices(column)
    assert part[2].tobytes() == b"bbcc d" and part[3].tolist() == [0, 2, 2, 6]


def test_code_points():
    data = np.frombuffer("aé😀b".encode(), np.uint8)
    points = textkit.codepoints_before(data)
    assert points[0] == 0 and points[-1] == 4 and points[len("aé".encode())] == 2


def test_ranges():
    assert textkit.gather_ranges(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]


@pytest.mark.parametrize("letters", [64, 1024, 2048, 4096])
def test_regular_words_have_hashes_of_their_own(letters):
    one = bytes(97 + (bin(i).count("1") & 1) for i in range(letters))
    words = [one, one.translate(bytes.maketrans(b"ab", b"ba")), one[::-1], one[1:], one[1:] + one[:1], b"a" * letters, b"a" * (letters + 1), b"b" * letters]
    data = np.frombuffer(b" ".join(words), np.uint8)
    w = textkit.words_of(data, np.array([0, len(data)]), textkit.space_words())
    assert len(set(w.hashes().tolist())) == len(set(words))
    empty = textkit.span_hashes(data, np.array([3, 3]), np.array([3, 5]))
    assert empty[0] != empty[1]
