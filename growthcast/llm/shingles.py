"""64-bit hashes of words and of runs of words, for whole texts at once.

The functions run inside tasks on one document at a time, on arrays only. A
word's hash is a sum over its bytes, a run's hash a sum over its words, each
term times a power of an odd number from the start on; differences of running
sums give any of them. Two different words, or runs, share a hash with
probability 2^-64.
"""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2^64.
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Hasher:
    """Makes ``Runs`` of texts; keeps the tables that it needs for that."""

    def __init__(self):
        self.of_byte = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
        # words are separated by the space and U+0009 to U+000D, which no other UTF-8 sequence contains
        self.inside = np.ones(256, bool)
        self.inside[[32, *range(9, 14)]] = False
        self.powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def runs(self, text: bytes) -> Runs:
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        if len(self.powers[0]) <= n:
            m = 2 << n.bit_length()
            self.powers = tuple(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, x, np.uint64))).cumprod(dtype=np.uint64) for x in (_MUL, _INV))
        edge = np.zeros(n + 2, np.int8)
        edge[1:-1] = self.inside[data]
        edge = np.flatnonzero(edge[1:] != edge[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.powers[1][:n], out=sums[1:])
        return Runs(mixed((sums[end] - sums[start]) * self.powers[0][start]), *self.powers)


class Runs:
    """Hashes of the runs of one document's words."""

    def __init__(self, words: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        self.n, self.powers = len(words), powers
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * inverse[:self.n], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start to end - 1, for arrays of places."""
        return mixed((self.sums[end] - self.sums[start]) * self.powers[start])

    def of(self, n: int) -> np.ndarray:
        """Hash of every run of n words; empty if there are fewer."""
        if self.n < n:
            return np.empty(0, np.uint64)
        return mixed((self.sums[n:] - self.sums[:self.n + 1 - n]) * self.powers[:self.n + 1 - n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX
    return h ^ (h >> np.uint64(32))
