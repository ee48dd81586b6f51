"""Words, word shingles and their hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from .kept import Kept

#: Words whose hashes a worker keeps, twice at most.
KEPT_WORDS = 100_000


class WordHashes(Kept):
    """64-bit hashes of words."""

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


WORD_HASHES = WordHashes(KEPT_WORDS)


def words_of(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: An odd number: a shingle's hash is a polynomial of its words' hashes in it, then mixed.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """uint64 hashes of all n-word shingles in order; with fewer words the whole sequence is one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    size = len(words) - k + 1
    acc = h[:size].copy()
    for i in range(1, k):
        acc *= FACTOR
        acc += h[i : i + size]
    return mixed(acc + np.uint64(k))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(words_of(text), n))
