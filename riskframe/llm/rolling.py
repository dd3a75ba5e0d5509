"""Vectorised polynomial fingerprints of byte and word sequences (arithmetic modulo 2**64)."""
from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads the weak low bits of a polynomial sum."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Roller:
    """Fingerprints of slices of one sequence in constant time each, by prefix sums of v[i] * base**i."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) | 5
        self.inv = pow(self.base, -1, 1 << 64)
        self.pow = np.ones(1, np.uint64)
        self.ipow = np.ones(1, np.uint64)

    def _powers(self, n: int):
        while len(self.pow) < n:
            m = len(self.pow)
            self.pow = np.concatenate([self.pow, self.pow * _U(pow(self.base, m, 1 << 64))])
            self.ipow = np.concatenate([self.ipow, self.ipow * _U(pow(self.inv, m, 1 << 64))])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums; bytes are first replaced by random 64-bit values."""
        n = len(values)
        self._powers(n + 1)
        if values.dtype == np.uint8:
            values = self.table[values]
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.pow[:n], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.ipow[start])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Fingerprint of every ``width`` consecutive elements."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[width:] - prefix[:-width]) * self.ipow[:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive elements, by doubling."""
    if len(a) < width:
        return a[:0]
    w = 1
    while 2 * w <= width:
        a = np.minimum(a[:-w], a[w:])
        w *= 2
    if w < width:
        a = np.minimum(a[:len(a) - (width - w)], a[width - w:])
    return a


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (maximal run without bytes of ``space``) of concatenated rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the given intervals."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:-1]) > 0
