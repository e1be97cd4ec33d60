"""Small dense algebra on the driver; nothing here grows with the rows."""

from __future__ import annotations

import math

import numpy as np

#: Added to the diagonal in turn until the factor exists.
JITTER = (0.0, 1e-10, 1e-9)


def cholesky(h: np.ndarray) -> np.ndarray:
    """Lower factor of a positive definite matrix."""
    for extra in JITTER:
        try:
            return np.linalg.cholesky(h + extra * np.eye(len(h)))
        except np.linalg.LinAlgError:
            continue
    raise RuntimeError("the Hessian isn't positive definite")


def preconditioner(diagonal: np.ndarray) -> np.ndarray:
    """The diagonal preconditioner of a matrix, by its own diagonal."""
    return 1.0 / (diagonal + 1e-12)


def conjugate_gradients(product, b: np.ndarray, diagonal: np.ndarray | None = None, tol: float = 1e-10, max_iter: int = 1000) -> np.ndarray:
    """Solves A x = b by products with A alone, positive definite; diagonal is a preconditioner.

    Ends when the residual's norm (under the preconditioner) is below tol, after max_iter products, or when a direction
    has no curvature left.
    """
    x, r = np.zeros_like(b, dtype=float), np.asarray(b, float).copy()
    scaled = lambda r: r if diagonal is None else diagonal * r
    z = scaled(r)
    p, rz = z.copy(), float(r @ z)
    for _ in range(max_iter):
        if math.sqrt(abs(rz)) < tol:
            break
        ap = product(p)
        curvature = float(p @ ap)
        if abs(curvature) < 1e-18:
            break
        x = x + rz / curvature * p
        r = r - rz / curvature * ap
        z = scaled(r)
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x


def condition(h: np.ndarray) -> float:
    values = np.linalg.eigvalsh(h)
    return float(values[-1] / values[0]) if values[0] > 0 else math.inf


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = out = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(out):
            k += 1
            term *= x / k
            out += term
        return front * out
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: int) -> float:
    """Value below which a chi-square variable of df degrees stays with probability p."""
    low, high = 0.0, float(df) + 10.0
    while _lower_gamma(df / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _lower_gamma(df / 2, middle / 2) < p else (low, middle)
    return (low + high) / 2


def log_ball(d: int) -> float:
    """Log volume of the unit ball."""
    return d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1)


def log_det(h: np.ndarray) -> float:
    return float(2 * np.log(np.diag(cholesky(h))).sum())
