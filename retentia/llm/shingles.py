"""Hashed words and word shingles of a text."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd 64-bit multipliers.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_KNOWN_WORDS = 150_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = values * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    """Hashes of the words of a text in UTF-8: A-Z in lower case, split at ASCII white space."""
    words = text.lower().split()  # bytes: both concern ASCII only
    return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole
    sequence if there are fewer words; empty without words."""
    if not len(words):
        return words
    n = min(size, len(words))
    acc = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        acc = mixed(acc ^ words[i : len(words) - n + 1 + i])
    return np.unique(acc)
