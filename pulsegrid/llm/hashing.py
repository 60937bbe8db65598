"""Hashes of words and of runs of words, for whole documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, with a bounded memory of recent ones."""

    def __init__(self):
        self.seen: dict = {}

    def __call__(self, words: list) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([seen[w] for w in words], np.uint64)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; none if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + h[i : i + n]
    return mix(out)
