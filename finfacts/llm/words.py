"""Word hashes, shingles and MinHash values of whole texts, vectorised over a slice of documents."""

from __future__ import annotations

import numpy as np
import xxhash

from finfacts.llm.common import cache_of

SHINGLE = 5
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_KNOWN = 150_000


class WordHashes(dict):
    """64-bit hashes of words seen lately (bounded; cleared when full)."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= _KNOWN:
                self.clear()
            self[word] = h
        return h


HASHES = WordHashes()
cache_of("words", HASHES.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased, white-space separated words of the whole text."""
    words = text.lower().split() if text else []
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(hashes: list[np.ndarray], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts with at least one word, and where each text's begin.

    A text of fewer than ``size`` words has one shingle of all its words.
    """
    n = np.array([len(h) for h in hashes])
    long = n >= size
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    starts = np.cumsum(n) - n
    count = np.where(long, n - size + 1, 1)
    first = np.cumsum(count) - count
    at = np.repeat(starts - first, count) + np.arange(count.sum())
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = np.minimum(at + k, len(flat) - 1)
        part = flat[inside] if long.all() else np.where(np.repeat(long | (k < n), count), flat[inside], np.uint64(0))
        out = out * _MIX[2] + part
    return mix(out), first


def minhash(values: np.ndarray, first: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(texts, hashes) MinHash values of 32 bits; ``seeds`` holds an odd factor and a mask per hash function."""
    out = np.empty((len(first), len(seeds)), np.uint32)
    for k, (factor, mask) in enumerate(seeds):
        out[:, k] = np.minimum.reduceat((values ^ mask) * factor, first) >> np.uint64(32)
    return out


def minhash_seeds(n: int, seed: int = 7) -> np.ndarray:
    r = np.random.default_rng(seed).integers(0, 1 << 63, (n, 2), dtype=np.uint64) * np.uint64(2)
    r[:, 0] |= np.uint64(1)
    return r
