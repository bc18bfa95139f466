"""Hashes of words, shingles and prefixes over whole Arrow batches, without a Python loop over words.

A text column's bytes are one array; with B odd, the hash of bytes s..e is (P[e] - P[s]) * B^-s where P sums byte * B^i,
all modulo 2^64. ASCII letters are lower-cased, bytes from 128 on count as letters, any number counts as one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_low[48:58] = 48
_cased = np.arange(256, dtype=np.uint8)
_cased[65:91] += 32
_word = np.zeros(256, bool)
_word[48:58] = _word[65:91] = _word[97:123] = True
_word[39] = True
_word[128:] = True
_term = np.zeros(256, bool)
_term[[10, 33, 46, 63]] = True  # line end ! . ?
NUMBER = np.uint64(0x51ED270B27B4F3CF)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("b", ())) < n + 1:
        for k, base in (("b", _B), ("i", _B_INV)):
            x = np.full(max(n, 1 << 20) + 1, base, np.uint64)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow["b"], _pow["i"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def span_sums(data: np.ndarray) -> np.ndarray:
    b, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * b[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(sums))
    h = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a batch: hash h, text index doc, whether a word ends a sentence (term) or the text (last)."""

    def __init__(self, col: pa.Array) -> None:
        data, off = buffers(col)
        self.n = len(off) - 1
        isw = _word[data]
        before, after = np.zeros_like(isw), np.zeros_like(isw)
        before[1:], after[:-1] = isw[:-1], isw[1:]
        inner = off[1:-1]
        before[inner[inner < len(isw)]] = False
        ends = inner[inner > 0] - 1
        after[ends] = False
        s, e = np.flatnonzero(isw & ~before), np.flatnonzero(isw & ~after) + 1
        self.at, self.data = (s, e), data
        self.h = span_hash(span_sums(_low[data]), s, e)
        digit = (data[s] >= 48) & (data[s] < 58) if len(s) else np.empty(0, bool)
        self.h[digit] = NUMBER
        self.doc = np.searchsorted(off, s, "right") - 1
        t = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_term[data], out=t[1:])
        self.last = np.r_[self.doc[1:] != self.doc[:-1], True] if len(s) else np.empty(0, bool)
        nxt = np.where(self.last, off[self.doc + 1], np.r_[s[1:], 0]) if len(s) else s
        self.term = t[nxt] > t[e]
        self.first = np.r_[True, self.last[:-1]] if len(s) else np.empty(0, bool)
        self.start = np.flatnonzero(self.first)  # of each text that has words
        self.has = self.doc[self.start]
        self.count = np.bincount(self.doc, minlength=self.n)

    def shingles(self, k: int, numbers: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row and their text index; numbers: different numbers are different words."""
        h = span_hash(span_sums(_cased[self.data]), *self.at) if numbers else self.h
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(_B) + h[i : i + n]
        ok = self.doc[:n] == self.doc[k - 1 : k - 1 + n]
        return mix(out[ok]), self.doc[:n][ok]


def min_hashes(sh: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k min-hashes (a column each) of every text that has shingles, and those texts."""
    if not len(sh):
        return np.empty((k, 0), np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rng = np.random.default_rng(7)
    out = np.empty((k, len(at)), np.uint64)
    for i, (a, b) in enumerate(rng.integers(1, 2**63, (k, 2), dtype=np.uint64)):
        v = (sh ^ b) * (a | np.uint64(1))
        v ^= v >> np.uint64(32)
        np.minimum.reduceat(v, at, out=out[i])
    return out, doc[at]
