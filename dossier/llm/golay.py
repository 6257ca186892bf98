"""The perfect binary Golay code (23, 12, 7): every 23-bit word lies within 3 bits of one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH = 23


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """For each 23-bit word, the 12-bit index of its nearest codeword."""
    words = np.arange(1 << 23, dtype=np.uint32)
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    leaders = np.zeros(1 << 11, np.uint32)
    for weight in (3, 2, 1, 0):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            leaders[rest[error]] = error
    return ((words ^ leaders[rest]) >> np.uint32(11)).astype(np.uint16)


def nearby_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each 23-bit word: the codeword indices of the word and of all words one bit away.

    Two words that differ in at most two bits share one of them, since some word is within
    one bit of both. A word has one or six keys. Returns (position of the word, key).
    """
    table = decoder()
    keys = np.empty((len(words), 24), np.uint16)
    keys[:, 23] = table[words]
    for bit in range(23):
        keys[:, bit] = table[words ^ np.uint32(1 << bit)]
    keys.sort(axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    at, column = np.nonzero(fresh)
    return at, keys[at, column]
