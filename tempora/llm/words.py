"""Words of texts as numpy hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CACHE_WORDS = 150_000


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between runs of space, \\t, \\n, \\v, \\f and \\r, as bytes; lower-cases A-Z alone."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


class Hasher(dict):
    """64-bit hashes of words; `key` maps a word to what is hashed."""

    def __init__(self, key=None) -> None:
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(self.key(word) if self.key else word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def joined(lists: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation and offsets."""
    lists = list(lists)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return (np.concatenate(lists) if lists else np.zeros(0, np.uint64)), offsets


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words: one less than n fewer than there are words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mixed(out * BASE + hashes[k : k + m])
    return out
