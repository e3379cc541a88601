import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kernel as K

TEXTS = st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=6)


@settings(deadline=None)
@given(TEXTS)
def test_words_are_runs_of_letters_and_digits(texts):
    texts = [t.replace("\0", " ") for t in texts]
    w = K.Words(texts)
    for i, t in enumerate(texts):
        got = ["".join(map(chr, w.cp[a:b])) for a, b in zip(w.s[w.ptr[i] : w.ptr[i + 1]], w.e[w.ptr[i] : w.ptr[i + 1]], strict=True)]
        if all(ord(c) < 0x300 for c in t):
            assert got == re.findall(r"[^\W_]+", t)
        for x in got:
            assert x in t


def test_hashes_depend_on_the_word_alone():
    a, b = K.Words(["x The cat", "THE"]), K.Words(["cat the"])
    assert a.h[1] == a.h[3] == b.h[1] and a.h[2] == b.h[0] and a.h[0] != a.h[1]
    assert K.hash64("the") == int(b.h[1])


def test_spans_hash_is_of_the_contents():
    v = np.array([5, 6, 7, 1, 5, 6, 7, 0, 5, 6], np.uint64)
    h = K.spans_hash(v, np.array([0, 4, 8, 0]), np.array([3, 7, 10, 2]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_grams_are_padded_at_the_end_of_a_text():
    w = K.Words(["a b c", "b c", ""])
    g = w.grams(2)
    assert g[1] == g[3] and g[2] == g[4] and g[0] != g[1]


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_lookup(keys, others):
    keys = list(keys)
    table = K.Lookup(np.array(keys, np.uint64))
    assert table(np.array(keys, np.uint64)).tolist() == list(range(len(keys)))
    for x in others:
        assert table(np.array([x], np.uint64))[0] == (keys.index(x) if x in keys else -1)


def test_lookup_settles_shared_slots():
    keys = np.arange(1000, dtype=np.uint64)  # all in one slot
    table = K.Lookup(keys)
    assert table(np.array([0, 999, 1000], np.uint64)).tolist() == [0, 999, -1]


def test_reduce_by_handles_empty_texts():
    assert K.reduce_by(np.add, np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3]), 0).tolist() == [0, 3, 0, 3, 0]
