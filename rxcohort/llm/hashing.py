"""Hashes of many substrings of a text at once."""

from __future__ import annotations

from functools import cache

import numpy as np

ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SEGMENT = 1 << 18  # bytes taken together

# A byte's value in a hash, drawn once and for all.
_VALUE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Substrings:
    """64-bit hashes of substrings of ``octets``, the same wherever a substring stands.

    A hash is the sum of the bytes' values times powers of an odd number, read
    from running sums over the whole text and shifted back to the beginning.
    """

    def __init__(self, octets: np.ndarray) -> None:
        self.size = max(2 * SEGMENT, 1 << (len(octets) + 1).bit_length())
        self.sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum(_VALUE[octets] * _powers(int(ODD), self.size)[: len(octets)], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (self.sums[end] - self.sums[begin]) * _powers(pow(int(ODD), -1, 1 << 64), self.size)[begin]
        found ^= found >> np.uint64(32)
        found *= MIX
        return found ^ (found >> np.uint64(29))
