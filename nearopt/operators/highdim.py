"""The likelihood ratio where features are many beside the rows: by how much its chi-square is stretched.

For logistic regression with d / n = kappa and signal strength gamma (the standard deviation of the true margins), the
fitted vector is about alpha times the true one plus noise of size sigma, and the likelihood ratio of k coefficients is
kappa sigma^2 / lambda times a chi-square of k degrees (Sur and Candes, "A modern maximum-likelihood theory for
high-dimensional logistic regression", 2019).  alpha, sigma and lambda solve three equations of means over two normal
variables; these are taken by Gauss-Hermite quadrature and solved by Newton's steps.  gamma isn't seen, but the spread of
the margins that rows have under the fit without them is (Yadlowsky et al., "SLOE", 2021): one pass over the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from nearopt.functions import expressions as E
from nearopt.operators.fit import FittedSet

#: Points of the quadrature in each of the two variables.
POINTS = 60
#: Ratios d / n below this one aren't corrected: the factor differs from 1 by less than some d / n.
LEAST = 1e-6


def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z, w = np.polynomial.hermite_e.hermegauss(POINTS)
    w = w / w.sum()
    a, b = np.meshgrid(z, z, indexing="ij")
    return a.ravel(), b.ravel(), np.outer(w, w).ravel()


_Z1, _Z2, _W = _grid()


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(t / 2))


def prox(z: np.ndarray, lam: float) -> np.ndarray:
    """The x with x + lam sigmoid(x) = z."""
    low, high = z - lam, z.copy()
    x = z - lam * _sigmoid(z)
    for _ in range(100):
        p = _sigmoid(x)
        f = x + lam * p - z
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        step = x - f / (1 + lam * p * (1 - p))
        step = np.where((step < low) | (step > high), (low + high) / 2, step)
        if np.abs(step - x).max() < 1e-14 * max(1.0, float(np.abs(z).max())):
            return step
        x = step
    return x


def _equations(kappa: float, gamma: float, alpha: float, sigma: float, lam: float) -> np.ndarray:
    """What the three equations are off by; without signal the one of alpha, which is 0 then, is left out."""
    q1, q2 = gamma * _Z1, -alpha * gamma * _Z1 + math.sqrt(kappa) * sigma * _Z2
    x = prox(q2, lam)
    p = _sigmoid(x)
    one = 2 * _sigmoid(q1) * _W
    first = float((one * (lam * p) ** 2).sum()) / kappa**2 / sigma**2 - 1
    third = float((one / (1 + lam * p * (1 - p))).sum()) / (1 - kappa) - 1
    if gamma == 0:
        return np.array([first, third])
    return np.array([first, third, float((one / 2 * _Z1 * p).sum())])


def _solved(kappa: float, gamma: float, start: np.ndarray) -> np.ndarray | None:
    """(log sigma, log lambda, alpha) by damped Newton's steps from a start, or None."""
    free = 2 if gamma == 0 else 3
    x = start.copy()

    def off(v):
        with np.errstate(all="ignore"):
            return _equations(kappa, gamma, v[2] if free == 3 else 0.0, math.exp(v[0]), math.exp(v[1]))

    f = off(x)
    for _ in range(60):
        if np.abs(f).max() < 1e-11:
            return x
        jacobian = np.empty((free, free))
        for i in range(free):
            h = 1e-6 * max(1.0, abs(x[i]))
            up, down = x.copy(), x.copy()
            up[i] += h
            down[i] -= h
            jacobian[:, i] = (off(up) - off(down)) / (2 * h)
        try:
            step = np.linalg.solve(jacobian, -f)
        except np.linalg.LinAlgError:
            return None
        share = min(1.0, 1.0 / float(np.abs(step).max() + 1e-300))
        while share > 1e-6:
            new = x.copy()
            new[:free] += share * step
            g = off(new) if np.abs(new[:2]).max() < 30 else np.full(free, np.inf)
            if np.isfinite(g).all() and np.linalg.norm(g) < np.linalg.norm(f):
                break
            share /= 2
        else:
            return x if np.abs(f).max() < 1e-8 else None
        x, f = new, g
    return x if np.abs(f).max() < 1e-8 else None


def system(kappa: float, gamma: float) -> tuple[float, float, float] | None:
    """(alpha, sigma, lambda), or None where there is no solution: the classes can then be told apart entirely.

    The solution is followed from a small ratio, where alpha is 1 and the others have limits, in growing steps.
    """
    if not 0 < kappa < 1:
        raise ValueError("d / n must be in (0, 1)")
    if gamma < 0:
        raise ValueError("the signal's strength can't be below 0")
    spread = _sigmoid(gamma * _Z1)
    weight = float((_W * spread * (1 - spread)).sum())
    at = min(kappa, 1e-3)
    now = _solved(at, gamma, np.array([-0.5 * math.log(weight), math.log(at / weight), 1.0]))
    step = 1.5
    while now is not None and at < kappa:
        to = min(kappa, at * step)
        new = _solved(to, gamma, now + np.array([0.0, math.log(to / at), 0.0]))
        if new is None and step > 1.001:
            step = 1 + (step - 1) / 2
            continue
        at, now = to, new
    return None if now is None else (float(now[2]) if gamma > 0 else 0.0, math.exp(now[0]), math.exp(now[1]))


def factor_of(kappa: float, gamma: float) -> float | None:
    """By how much the chi-square is stretched; 1 for few features, None where there is no solution."""
    if kappa < LEAST:
        return 1.0
    found = system(kappa, gamma)
    return None if found is None else kappa * found[1] ** 2 / found[2]


def strength(kappa: float, spread: float) -> tuple[float, float] | None:
    """(gamma, factor) for the variance of the margins of rows that the fit hasn't seen, alpha^2 gamma^2 + kappa sigma^2;
    gamma is 0 where noise alone has that variance."""
    if kappa < LEAST:
        return math.sqrt(max(spread, 0.0)), 1.0

    def seen(gamma: float) -> tuple[float, float]:
        found = system(kappa, gamma)
        return (math.inf, math.nan) if found is None else ((found[0] * gamma) ** 2 + kappa * found[1] ** 2, kappa * found[1] ** 2 / found[2])

    none, factor = seen(0.0)
    if math.isinf(none):
        return None
    if none >= spread:
        return 0.0, factor
    low, high, best = 0.0, math.sqrt(spread), (0.0, factor)
    for _ in range(40):
        middle = (low + high) / 2
        value, factor = seen(middle)
        if value > spread:
            high = middle
        else:
            low, best = middle, (middle, factor)
        if high - low < 1e-7 * high:
            break
    return best


def unseen_spread(fitted: FittedSet) -> float:
    """The variance, over the rows, of each row's margin under the fit without it: one pass.  Leaving a row out moves the
    fit by a Newton step, whose effect on the row's own margin follows from its leverage."""
    m = E.dot(fitted.theta)
    p = E.sigmoid(m)
    leverage = F.pow(E.norm(fitted.inverse_factor), 2) / fitted.n
    moved = m + (p - F.col("y")) * leverage / (1 - p * (1 - p) * leverage)
    return float(fitted.frame.agg(F.var_pop(moved)).first()[0])


def correction(fitted: FittedSet) -> dict | None:
    """kappa, spread, gamma and factor of a logistic fit, or None where the equations have no solution."""
    if fitted.config.estimator != "logistic":
        raise ValueError("the correction is for logistic models")
    kappa, spread = fitted.d / fitted.n, unseen_spread(fitted)
    found = strength(kappa, spread) if kappa < 1 else None
    return None if found is None else {"kappa": kappa, "spread": spread, "gamma": found[0], "factor": found[1]}
