"""Words and word windows of many texts at once, as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes inside a word. Every byte of a character beyond ASCII is one, so texts need not be decoded.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

def _power(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h *= _BASE
    h ^= h >> np.uint64(32)
    return h


class Words:
    """Words of consecutive rows: ``begin`` and ``end`` in the bytes, ``row`` of each, ``hash`` of its lower-case bytes."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> None:
        self.data = LOWER[data]
        self.rows = len(edges) - 1
        word = inside[self.data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        starts[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.begin = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(edges, self.begin, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)
        #: the first word of each row, with one more entry for the end
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.begin]) * _power(_INVERSE, len(data) + 1)[self.begin])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of n words within one row, and their hashes."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        m = len(self.hash) - n + 1
        begin = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h *= _STEP
            h += self.hash[i : i + m]
        return begin, mix(h[begin])

    def text(self, word: int, n: int) -> bytes:
        """n words from the given one on, joined by single spaces."""
        return b" ".join(self.data[self.begin[i] : self.end[i]].tobytes() for i in range(word, word + n))
