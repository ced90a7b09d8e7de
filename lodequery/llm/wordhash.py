"""Words and word runs of many texts as 64-bit hashes, computed in numpy over one buffer of code points.

A word is a longest run of letters or digits, compared in lower case. The hash of a word is a polynomial of its code
points modulo 2^64, taken from prefix sums, then mixed; so no string object is made for a word.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator, Sequence

import numpy as np

#: An odd multiplier modulo 2^64 and the constants of a 64-bit finaliser.
_BASE = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Characters in a buffer; a longer text gets a buffer of its own.
BUFFER = 1 << 19


@functools.cache
def _word_chars() -> np.ndarray:
    """For each code point, whether it is a letter or digit; surrogates aren't."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX_2)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: ``hash``, ``text`` (index of the text), ``start`` and ``end`` in the buffer, and ``begin``, the first word of each text (with one entry more at the end)."""

    def __init__(self, texts: Sequence[str]):
        joined = "\n".join(texts)
        self.chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(self.chars)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _word_chars()[self.chars]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        size = 1 << max(BUFFER, n + 1).bit_length()
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.chars.astype(np.uint64) + np.uint64(1)) * _powers(pow(_BASE, -1, 1 << 64), size)[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_BASE, size)[self.start] + (self.end - self.start).astype(np.uint64))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.cumsum(lengths + 1) - lengths - 1  # where each text begins in the buffer
        self.begin = np.searchsorted(self.start, np.r_[self.offset, n + 1])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.begin))

    @classmethod
    def of_hashes(cls, lists: Sequence[np.ndarray]) -> "Words":
        """Words known by their hashes only, a list for each text."""
        w = cls.__new__(cls)
        w.hash = np.concatenate([np.zeros(0, np.uint64), *lists])
        counts = np.array([len(x) for x in lists], np.int64)
        w.begin = np.r_[0, np.cumsum(counts)].astype(np.int64)
        w.text = np.repeat(np.arange(len(lists)), counts)
        return w

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the index of each run's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(_BASE) + self.hash[i : i + n]
        return mix(h[at]), at


def buffers(texts: Sequence[str], size: int = BUFFER) -> Iterator[tuple[int, Words]]:
    """Lower-case words of the texts, some texts at a time, with the index of the first of them."""
    low = [t.lower() for t in texts]
    a = 0
    while a < len(low):
        b, chars = a + 1, len(low[a])
        while b < len(low) and chars + len(low[b]) < size:
            chars += len(low[b])
            b += 1
        yield a, Words(low[a:b])
        a = b
