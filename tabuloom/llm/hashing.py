"""Hashes of all words of a buffer at once, with array operations only."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LEAST = 1 << 18


@lru_cache(maxsize=3)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers below n, modulo 2^64."""
    both = []
    for value in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, value, dtype=np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def powers(length: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers for at least `length` places."""
    n = LEAST
    while n < length:
        n *= 2
    return _powers(n, base)


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of the values of each span."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of integers of 64 bits over each other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every run of bytes for which the table `is_word` holds."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return spans(data, start, end), start, end


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))))
