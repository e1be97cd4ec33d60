"""Column expressions of the model family; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widest vector whose products are written out term by term; wider ones are folded over arrays.
UNROLL = 24


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def columns(d: int) -> list[Column]:
    return [F.col(f"x{j}") for j in range(d)]


def dot(theta: Sequence[float], xs: Sequence[Column] | None = None) -> Column:
    """theta . x over the columns x0, x1, ..."""
    xs = columns(len(theta)) if xs is None else xs
    if len(xs) <= UNROLL:
        return total([F.lit(float(t)) * x for t, x in zip(theta, xs)])
    pairs = F.zip_with(F.array(*xs), F.array(*[F.lit(float(t)) for t in theta]), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(matrix: np.ndarray) -> Column:
    """Euclidean norm of matrix . x."""
    rows = [dot(row) for row in matrix]
    return F.sqrt(total([r * r for r in rows]))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def loss(estimator: str, margin: Column, y: Column) -> Column:
    """Loss of one row."""
    if estimator == "logistic":
        return softplus(margin) - y * margin
    return 0.5 * (y - margin) * (y - margin)


def weyl(k: Column, step: float) -> Column:
    """Fractional part of k * step: an even sequence in [0, 1) that any engine computes alike."""
    return k * F.lit(step) - F.floor(k * F.lit(step))
