"""Vectorised hashing of words and of windows of words.

Words are runs of bytes other than ASCII white space.  A word's hash is a
polynomial over random values of its bytes; a window's hash is a polynomial over
its words' hashes.  Both come from running sums modulo 2**64, so a window costs
the same whatever its length, and both are scrambled at the end.
"""
from __future__ import annotations

import numpy as np

_PIECE = 1 << 20  # bytes hashed at a time
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.steps = (base, pow(base, -1, 2**64))
        self.tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            for i, step in enumerate(self.steps):
                factor = np.uint64(pow(step, m, 2**64))
                self.tables[i] = np.r_[self.tables[i], self.tables[i] * factor]
        return self.tables[0][:n], self.tables[1][:n]


_IN_WORD = _Powers(0x9E3779B97F4A7C15)
#: Bases of independent window hashes.
_IN_WINDOW = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


def _spans(values: np.ndarray, powers: _Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return (sums[end] - sums[start]) * down[start]


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a text's bytes."""
    return scramble(_spans(_BYTES[b], _IN_WORD, start, end) + (end - start).astype(np.uint64))


def _pieces(raw: bytes):
    """Cut long texts at white space, so that arrays stay small."""
    lo = 0
    while len(raw) - lo > 2 * _PIECE:
        cut = next((i for i in range(lo + _PIECE, len(raw)) if _WHITE[raw[i]]), len(raw))
        yield raw[lo:cut]
        lo = cut
    yield raw[lo:]


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a UTF-8 text."""
    out = []
    for piece in _pieces(raw):
        b = np.frombuffer(piece, dtype=np.uint8)
        word = np.zeros(len(b) + 2, dtype=np.int8)
        word[1:-1] = ~_WHITE[b]
        step = np.diff(word)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(start):
            out.append(span_hashes(b, start, end))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every window of so many words, by its first word's number."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    start = np.arange(n)
    return scramble(_spans(words, _IN_WINDOW[which], start, start + length))


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, one
    without words has none."""
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(length, len(words))))
