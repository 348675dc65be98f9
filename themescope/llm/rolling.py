"""Hashes over all places of a byte string, with numpy. Everything is modulo 2**64."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDED = np.random.default_rng(20240229)
TABLE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on; k is a power of two."""
    h, step, power = TABLE[data], 1, int(BASE)
    while step < k:
        h = h[:-step] * np.uint64(power) + h[step:] if len(h) > step else h[:0]
        step, power = step * 2, power * power % 2**64
    return h


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each place on."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


class Prefix:
    """Hash of any part of a byte string in constant time."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers) < n:
            size = max(n, 2 * len(cls.powers))
            with np.errstate(over="ignore"):
                cls.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]), dtype=np.uint64)
                cls.inverses = np.cumprod(
                    np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INVERSE)]), dtype=np.uint64
                )

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * self.powers[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
