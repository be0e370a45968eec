"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words (bytes); forgets all when full, so that memory stays bounded."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at the ASCII whitespace of the contracts (bytes.split splits at just those)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle, no words none."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - k + 1)
    x = np.full(n, np.uint64(min(k, len(h))))
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            x = mix(x * np.uint64(31) + h[i : i + n])
    return np.unique(x)
