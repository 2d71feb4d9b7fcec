"""Words of a text and hashes of their windows, for functions that run on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a task keeps, about 200 bytes each; beyond that the table is begun anew.
CACHE = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words, kept while the task lasts."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for word in set(words).difference(known):
                known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; a shorter text is one window, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = hashes[: n - width + 1].copy()
    for i in range(1, width):
        out = mixed(out) * _MIX + hashes[i : n - width + 1 + i]
    return mixed(out)
