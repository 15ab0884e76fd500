"""Words and 64-bit word hashes of texts inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash per word; a bounded table of the words seen so far."""

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(words: list) -> np.ndarray:
    """The same hashes without a table: as much time for rare words, and no memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble, element by element."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Order-dependent hash of equally long rows of hashes."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mix(out * MULTIPLIER + part)
    return out


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by the position of its first word."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    return chain([hashes[k : k + count] for k in range(size)])


class RunHashes:
    """Hashes of any run of words of a text from sums over its prefixes, modulo 2^64."""

    def __init__(self, hashes: np.ndarray, multiplier: int = 0x9E3779B97F4A7C15):
        n = len(hashes)
        power, self.back = self._powers(multiplier, n), self._powers(pow(multiplier, -1, 1 << 64), n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(multiplier)) * power[:n], dtype=np.uint64)])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, starts: np.ndarray, size) -> np.ndarray:
        """Hash of the ``size`` words from each start on."""
        return mix((self.sums[starts + size] - self.sums[starts]) * self.back[starts] + np.asarray(size).astype(np.uint64))
