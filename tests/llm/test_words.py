import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.llm import _words as W
from tests.llm import helpers

TEXT = st.text(alphabet=st.sampled_from("abAB \t\n\x0b\x0c\r\x1c\x85\u00a0é|.😀"), max_size=30)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_definition(texts):
    got = []
    for _, _, buf, offs in W.slices(pa.array(texts, pa.string())):
        found = W.words(buf, offs)
        spans = [bytes(buf[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]
        got += [spans[a:b] for a, b in zip(found.first, found.first[1:], strict=False)]
    assert got == [helpers.words(t) for t in texts]


@given(st.lists(TEXT, min_size=1, max_size=6))
def test_equal_folded_words_have_equal_hashes(texts):
    seen = {}
    for _, _, buf, offs in W.slices(pa.array(texts, pa.string())):
        found = W.words(buf, offs)
        for h, a, b in zip(found.hash, found.start, found.end, strict=True):
            assert seen.setdefault(helpers.fold(bytes(buf[a:b]).decode()), h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(TEXT, max_size=6))
def test_shingles_are_counted(texts):
    sizes = []
    for lo, hi, buf, offs in W.slices(pa.array(texts, pa.string())):
        at, _ = W.shingles(W.words(buf, offs), 5)
        sizes += np.bincount(at, minlength=hi - lo).tolist()
    assert sizes == [len(helpers.shingle_set(t)) for t in texts]


def test_slices_cover_long_texts(monkeypatch):
    monkeypatch.setattr(W, "SLICE", 10)
    texts = ["a b", None, "x" * 50, "", "c d e f g h"]
    parts = [(lo, hi) for lo, hi, _, _ in W.slices(pa.array(texts))]
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert list(W.slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("word", ["ab", "ba", "aab", "aba"])
def test_order_of_letters_counts(word):
    buf, offs = np.frombuffer(f"{word} {word[::-1]}".encode(), np.uint8), np.array([0, 2 * len(word) + 1])
    h = W.words(buf, offs).hash
    assert (h[0] == h[1]) == (word == word[::-1])
