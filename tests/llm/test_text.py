"""Words, hashes and shingle sets against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spreadlab.llm import _text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB éß\t\n.,zÉ漢", max_size=60)), max_size=6)


def lowered(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_an_expression(texts):
    for lo, hi, buf, at in T.chunks(pa.array(texts, pa.string()), 20):
        w = T.Words(T.LOWER[buf], at, T.NOT_SPACE)
        got = [[bytes(T.LOWER[buf][a:b]).decode() for a, b, r in zip(w.start, w.end, w.row, strict=True) if r == k] for k in range(hi - lo)]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", lowered(x)) for x in texts[lo:hi]]


def test_chunks_cover_slices_and_long_texts():
    column = pa.array(["x", "aa bb", None, "c" * 50, ""], pa.string()).slice(1)
    seen = [(lo, hi, bytes(buf)) for lo, hi, buf, _ in T.chunks(column, 8)]
    assert [b for *_, b in seen] == [b"aa bb", b"c" * 50, b""] or b"".join(b for *_, b in seen) == b"aa bb" + b"c" * 50
    assert seen[0][0] == 0 and seen[-1][1] == 4


def test_equal_words_have_equal_hashes_anywhere():
    words = ["a", "b", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 5, "abcdefgh" * 5 + "x", "a" * 2000]
    text = " ".join(words + words[::-1])
    buf, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    h = T.Words(buf, at, T.NOT_SPACE).hash
    assert (h[: len(words)] == h[len(words) :][::-1]).all() and len(set(h.tolist())) == len(words)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingle_sets_have_the_right_sizes(texts):
    column = pa.array(texts, pa.string())
    for lo, hi, buf, at in T.chunks(column):
        g, bounds = T.shingle_sets(buf, at, 2)
        for k, x in enumerate(texts[lo:hi]):
            w = re.findall(r"[^\x20\x09-\x0D]+", lowered(x))
            want = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} - {()}
            own = g[bounds[k] : bounds[k + 1]]
            assert len(own) == len(want) and (np.diff(own.astype(float)) >= 0).all()
