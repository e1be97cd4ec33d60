"""Even numbers: multiples of square roots of primes modulo 1, which any engine computes alike."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np


def _primes() -> Iterator[int]:
    n = 2
    while True:
        if all(n % p for p in range(2, math.isqrt(n) + 1)):
            yield n
        n += 1


def even_steps(n: int) -> np.ndarray:
    """Square roots of the first n primes, whose multiples are even numbers modulo 1."""
    return np.sqrt([p for _, p in zip(range(n), _primes())])


def even(k: np.ndarray, n: int) -> np.ndarray:
    """n numbers in [0, 1) for each of the counts k: k * sqrt(prime) modulo 1, which any engine computes alike."""
    x = np.asarray(k, float)[:, None] * even_steps(n)
    return x - np.floor(x)


def even_normals(k: np.ndarray, d: int) -> np.ndarray:
    u = even(k, 2 * d)
    return np.sqrt(-2 * np.log(u[:, ::2])) * np.cos(2 * math.pi * u[:, 1::2])
