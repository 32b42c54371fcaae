"""Sets of hashed word shingles, as numpy arrays inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
#: Two odd 64-bit multipliers (from the golden ratio and from splitmix64's finalizer) and its second one.
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for one worker up to a bound on their number."""

    def __init__(self, bound: int = 150_000):
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(raw: bytes, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text.

    A-Z is lower-cased; words are runs of bytes other than space and \\t-\\r; with fewer words than width, the
    whole sequence is one shingle; without words the set is empty.
    """
    split = raw.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = min(width, len(split))
    out = np.full(len(split) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _GOLD + h[k : k + len(out)])
    return np.unique(out)
