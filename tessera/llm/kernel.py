"""Vectorised text kernel shared by the corpus operators.

Executors see documents as Arrow batches. This module turns a run of texts into flat numpy arrays (code points, word
bounds, 64-bit word hashes, word-to-document offsets), so an operator touches each character a fixed number of times
and never loops over words in Python. Whole texts are always used; a run of texts is cut into chunks of about a million
characters only to bound memory, and a chunk never splits a document.

A word is a maximal run of letters, digits and combining marks, compared after simple lower-casing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 1 << 20
_LIMIT = 0x32000
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
PAD = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing generator, element by element."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers that depend only on the salt."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) * _U(_BASE)) ^ _U(salt * 0x2545F4914F6CDD1D % (1 << 64)))


def hash64(text: str) -> int:
    """The hash that `Words` gives to this text if it is one word in lower case."""
    w = Words([text])
    return int(w.h[0]) if len(w.h) else 0


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Code point to lower-case code point, 0 for what isn't part of a word."""
    table = np.zeros(_LIMIT, np.uint32)
    for i in range(1, _LIMIT):
        c = chr(i)
        if c.isalnum() or (i > 0x2FF and unicodedata.category(c)[0] == "M"):
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < _LIMIT else i
    return table


@lru_cache(1)
def upper_table() -> np.ndarray:
    return np.array([False] + [chr(i).isupper() for i in range(1, _LIMIT)])


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_CHARS * 5 // 4)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for every span, equal for equal contents wherever they stand."""
    n = len(values)
    p, inv = powers(n)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * p[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a NUL after each, and where each text starts (one entry more than texts)."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    if len(cp) and cp.max() >= _LIMIT:
        cp = np.where(cp < _LIMIT, cp, 0xFFFD).astype(np.uint32)
    return cp, at


class Words:
    """Words of a run of texts: cp, at (text starts), s and e (word bounds in cp), h (hashes), doc, ptr (word offsets)."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        self.cp, self.at = codes(texts)
        low = lower_table()[self.cp]
        edge = np.flatnonzero(np.diff((low != 0).view(np.int8), prepend=0))
        self.s, self.e = edge[::2], edge[1::2]
        self.h = spans_hash(low, self.s, self.e)
        self.ptr = np.searchsorted(self.s, self.at)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int64), np.diff(self.ptr))

    def grams(self, k: int) -> np.ndarray:
        """A hash for each word with the k-1 after it; past the end of its text stand pads, so every word has one."""
        h, n = self.h, len(self.h)
        end = self.ptr[1:][self.doc]
        i = np.arange(n)
        g = h.copy()
        with np.errstate(over="ignore"):
            for j in range(1, k):
                after = np.full(n, PAD)
                after[: n - j] = h[j:]
                after[i + j >= end] = PAD
                g = g * _U(0xD6E8FEB86659FD93) + after
            return mix(g)


def reduce_by(ufunc: np.ufunc, values: np.ndarray, ptr: np.ndarray, empty: object) -> np.ndarray:
    """ufunc over values[ptr[i]:ptr[i+1]], `empty` where there are none."""
    out = np.full(len(ptr) - 1, empty, values.dtype)
    some = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(some):
        out[some] = ufunc.reduceat(values, ptr[:-1][some])
    return out


class Lookup:
    """An index of distinct 64-bit keys: positions of many keys at once, -1 for absent ones.

    A direct-mapped table answers most probes with two reads; a binary search settles the slots that keys share.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]
        bits = max(10, min(24, int(len(keys)).bit_length() + 3))
        self.shift = _U(64 - bits)
        slot = (keys >> self.shift).astype(np.int64)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[slot] = np.arange(len(keys), dtype=np.int32)
        self.slot[np.bincount(slot, minlength=1 << bits) > 1] = -2
        self.keys = keys

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.slot[(h >> self.shift).astype(np.int64)].astype(np.int64)
        single = np.flatnonzero(out >= 0)
        out[single[self.keys[out[single]] != h[single]]] = -1
        shared = np.flatnonzero(out == -2)
        if len(shared):
            at = np.minimum(np.searchsorted(self.sorted, h[shared]), len(self.sorted) - 1)
            out[shared] = np.where(self.sorted[at] == h[shared], self.order[at], -1)
        return out


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null as empty), about `limit` bytes of text each, at least one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = int(size[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + limit, "right")))
            part = batch.slice(begin, end - begin)
            yield part, ["" if t is None else t for t in part.column(text).to_pylist()]
            begin = end


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def batch_of(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array | pa.ChunkedArray) else pa.array(v) for k, v in columns.items()})
