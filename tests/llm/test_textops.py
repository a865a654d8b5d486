import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillet.llm import textops as T

texts = st.lists(st.text(max_size=60), max_size=6)


def naive_words(s):
    out, word = [], ""
    for c in s:
        ok = c.isascii() and c.isalnum() or (ord(c) >= 0xC0 and not 0x2000 <= ord(c) <= 0x207F and not 0x3000 <= ord(c) <= 0x303F)
        if ok:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_a_loop(ts):
    ts = [t.encode("utf-8", "ignore").decode() for t in ts]
    buf, off = T.flat(pa.array(ts, pa.string()))
    w = T.Words(buf, off)
    for d, t in enumerate(ts):
        lo, hi = w.first[d], w.first[d + 1]
        found = [buf[a:b].tobytes().decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])]
        assert found == naive_words(t)


def test_hash_depends_on_the_word_alone():
    buf, off = T.flat(pa.array(["Ärger und ärger", None, "x ÄRGER", "a" * 9000 + " " + "a" * 9001]))
    w = T.Words(buf, off)
    assert w.hash[0] == w.hash[2] == w.hash[4] and w.hash[1] != w.hash[0]
    assert w.hash[5] != w.hash[6]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_sliding_min_is_the_rightmost(values, w):
    h = np.array(values, np.uint64)
    naive = [max(j for j in range(i, i + w) if h[j] == h[i : i + w].min()) for i in range(len(h) - w + 1)]
    assert T.sliding_min(h, w).tolist() == naive


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 6))
def test_grams_are_equal_where_the_words_are(values, k):
    h = T.mix(np.array(values, np.uint64))
    g = T.grams(h, k)
    for i in range(len(g)):
        for j in range(len(g)):
            assert (g[i] == g[j]) == (values[i : i + k] == values[j : j + k])


def test_chunks_cover_everything_once():
    off = np.array([0, 5, 5, 100, 101, 102])
    assert list(T.chunks(off, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(T.chunks(np.array([0]), 10)) == []


def test_a_buffer_of_one_sign():
    for t in ("\x80", "\xa0", "–", "é", "a"):
        w = T.Words(*T.flat(pa.array([t])))
        assert len(w.hash) == len(naive_words(t))
