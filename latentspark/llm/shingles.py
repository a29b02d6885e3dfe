"""Hashes of words and word shingles, inside tasks."""

import numpy as np
import xxhash

#: Words that a task remembers; beyond it the memory starts anew, with the same hashes.
MEMO = 400_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """White-space separated words to 64-bit hashes of their letters and digits, lower-cased; 0: it has none."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        bare = word.lower()
        if not bare.isalnum():
            bare = "".join(c for c in bare if c.isalnum())
        h = self[word] = (xxhash.xxh64_intdigest(bare) or 1) if bare else 0
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return hashes[hashes != 0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose values look random."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of `size` words, in order; fewer words than that are one run; none give none."""
    size = min(size, len(words))
    if size == 0:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    h = np.full(n, np.uint64(size))
    for j in range(size):
        h = h * _MIX[0] + words[j : j + n]
        h ^= h >> np.uint64(29)
    return mixed(h)
