"""Sets of distinct word shingles as sorted arrays of 64-bit hashes.

Words are runs of characters other than [\\x20\\x09-\\x0D] after A-Z are lower-cased. A text of fewer words than a shingle
has is one shingle, its whole sequence; a text without words has the empty set.
"""

from __future__ import annotations

import numpy as np
import xxhash

MEMO_WORDS = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Remembers the hashes of words, so that a text costs a look-up for each word and a few array operations."""

    def __init__(self, words: int = 5):
        self.k, self.memo = words, _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.k + 1)
        out = np.full(n, min(len(words), self.k), np.uint64)
        for i in range(min(len(words), self.k)):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out)
