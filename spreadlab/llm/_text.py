"""Texts of an Arrow column as flat arrays: word bounds and 64-bit hashes without a Python loop per word.

Hashes are of 64 bits: two different words or shingles fall together with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is taken alone, and whole.
CHUNK = 1 << 20
U = np.uint64
# Odd 64-bit multipliers of a public finalizer (MurmurHash3) and of splitmix64.
M1, M2, M3, M4, M5 = (U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LETTER = ALNUM.copy()
LETTER[48:58] = False


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= M1
    h ^= h >> U(33)
    h *= M2
    h ^= h >> U(33)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
        if column.type != pa.string():
            column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets into them)."""
    raw, at = flat(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """start and end of each word, the row that it is in, and its hash; bounds: per row, its first word."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, word_bytes: np.ndarray, hashed: bool = True):
        n = len(buf)
        inside = word_bytes[buf]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = at[:-1][at[:-1] < at[1:]]
            first[full] = inside[full]
            ends = at[1:][at[:-1] < at[1:]] - 1
            last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, at)
        self.count = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(at) - 1), self.count)
        if hashed:
            self.hash = spans_hash(buf, self.start, self.end)


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, eight at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))
    length = end - start
    h = length.astype(np.uint64) * M3
    todo, k = np.arange(len(start)), 0
    while len(todo):
        left = length[todo] - 8 * k
        x = eight[start[todo] + 8 * k] & _KEEP[np.minimum(left, 8)]
        x = (h[todo] ^ x) * M4
        x ^= x >> U(31)
        x *= M5
        x ^= x >> U(29)
        h[todo] = x
        todo, k = todo[left > 8], k + 1
    return mix(h)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n words that stays in its row."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    whole = words.row[:m] == words.row[n - 1 :]
    g = h[:m].copy()
    for k in range(1, n):
        g = mix(g * M3 + h[k : k + m])
    return g[whole], words.row[:m][whole]


def shingle_sets(buf: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): row r has the distinct hashes[bounds[r]:bounds[r + 1]], ascending.

    Words are what white space of ASCII separates, A-Z lower-cased; fewer than n words are one
    shingle, none is the empty set.
    """
    w = Words(LOWER[buf], at, NOT_SPACE)
    g, row = ngrams(w, n)
    bounds = np.searchsorted(row, np.arange(len(at)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        g[a:b].sort()
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(few):
        extra = np.empty(len(few), np.uint64)
        for i, r in enumerate(few.tolist()):
            one = np.array([w.count[r]], np.uint64)
            for k in range(w.bounds[r], w.bounds[r + 1]):
                one = mix(one * M3 + w.hash[k : k + 1])
            extra[i] = one[0]
        g, row = np.insert(g, bounds[few], extra), np.insert(row, bounds[few], few)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(at)))
