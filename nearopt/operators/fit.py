"""Fitting, guardrails, and the fitted set."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from nearopt.config import FeatureSpec, SetConfig
from nearopt.operators import linalg
from nearopt.operators.stats import Sums, sums

#: Guardrails: least p (1 - p) of a row, and largest condition number of the Hessian.
LEAST_WEIGHT, MOST_CONDITION = 1e-6, 1e8
#: The Newton step from where the mean gradient has this size is the last.
GRADIENT = 1e-11
#: Values of the rows that give a logistic fit its start.
START = 1_000_000


@dataclass(frozen=True, eq=False)
class FittedSet:
    """All models whose objective is within epsilon of the fitted one.  Immutable; small arrays only, and the frame."""

    config: SetConfig
    spec: FeatureSpec
    frame: DataFrame
    n: int
    theta: np.ndarray
    l_hat: float
    hessian: np.ndarray
    factor: np.ndarray
    kappa: float
    least_weight: float
    least_margin: float | None
    gram: np.ndarray | None
    cross: np.ndarray | None
    y2: float | None
    epsilon: float = math.nan
    alpha: float | None = None
    calibration: str = ""

    @property
    def d(self) -> int:
        return len(self.theta)

    @property
    def lam(self) -> float:
        return self.config.lam

    @property
    def inverse_factor(self) -> np.ndarray:
        """L^-1, so that |L^-1 s| is the norm of s under the inverse Hessian."""
        return np.linalg.solve(self.factor, np.eye(self.d))

    @property
    def reach(self) -> float:
        """sqrt(2 epsilon): how far functionals of unit norm move within the set's ellipsoid."""
        return math.sqrt(2 * self.epsilon)

    def with_epsilon(self, epsilon: float, alpha: float | None = None, calibration: str = "given") -> FittedSet:
        return replace(self, epsilon=float(epsilon), alpha=alpha, calibration=calibration)


def solve_linear(frame: DataFrame, d: int, penalty_of) -> tuple[np.ndarray, Sums]:
    """Ridge without intercept from one pass, and the sums at it, which follow from the same moments; the penalty for n
    rows counts against the summed loss."""
    at0 = sums(frame, d, "linear", np.zeros(d))
    theta = np.linalg.solve(at0.second + penalty_of(at0.n) * np.eye(d), -at0.first)
    loss = at0.loss + float(theta @ at0.first) + 0.5 * float(theta @ at0.second @ theta)
    return theta, replace(at0, first=at0.first + at0.second @ theta, loss=loss)


def _newton(measure, d: int, start: np.ndarray, penalty, max_iter: int) -> tuple[np.ndarray, Sums | None]:
    """Damped Newton steps from a start; measure(theta) gives sums, penalty(n) the penalty against the summed loss.
    With the sums at the result, if it was measured last."""
    theta, step, value, s = start, None, math.inf, None
    for _ in range(max_iter):
        s, at = measure(theta), theta
        share = penalty(s.n)
        new = s.loss / s.n + share / (2 * s.n) * float(theta @ theta)
        if step is not None and new > value + 1e-12 * abs(value) and np.abs(step).max() > 1e-12:
            step = step / 2
            theta = theta - step
            continue
        value = new
        gradient = (s.first + share * theta) / s.n
        step = -np.linalg.solve((s.second + share * np.eye(d)) / s.n, gradient)
        if np.abs(step).max() <= 1e-14 * max(1.0, np.abs(theta).max()):
            break
        theta = theta + step
        if np.abs(gradient).max() <= GRADIENT:  # what this step leaves is beyond the digits of a double
            break
    return theta, s if s is not None and at is theta else None


def _held_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> Sums:
    m = x @ theta
    p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
    w = p * (1 - p)
    return Sums(len(y), (x.T * w) @ x, x.T @ (p - y), float((np.logaddexp(0, m) - y * m).sum()), 0.0, None, 0.0)


def solve_logistic(frame: DataFrame, d: int, penalty_of, max_iter: int) -> tuple[np.ndarray, Sums | None]:
    """Penalised logistic regression without intercept by damped Newton steps, one pass over all rows each; with the sums
    at the result, if they were the last.

    The first START rows, solved for on the driver, give the start: a better one than 0 saves passes and changes nothing
    else, as the steps go on over all rows until the gradient is nothing.  Where it is no better, 0 is the start.
    """
    n = frame.count()
    held = frame.select(*[f"x{j}" for j in range(d)], "y").limit(START // max(d, 1)).toArrow().combine_chunks()
    x = np.stack([held.column(j).to_numpy() for j in range(d)], 1) if d else np.empty((0, 0))
    y = held.column(d).to_numpy().astype(float)
    ok = np.isfinite(x).all(1) & np.isfinite(y)
    x, y = x[ok], y[ok]
    start = np.zeros(d)
    if len(y):
        own = penalty_of(n) * len(y) / n  # the penalty's weight beside one row is that of the whole table
        start, _ = _newton(lambda theta: _held_sums(x, y, theta), d, start, lambda _: own, max_iter)
    first = sums(frame, d, "logistic", start)
    if not first.loss / first.n + penalty_of(first.n) / (2 * first.n) * float(start @ start) <= math.log(2):  # the value at 0
        start, first = np.zeros(d), None
    known = {start.tobytes(): first}
    return _newton(lambda theta: known.get(theta.tobytes()) or sums(frame, d, "logistic", theta), d, start, penalty_of, max_iter)


def at(frame: DataFrame, spec: FeatureSpec, config: SetConfig, theta, known: Sums | None = None) -> FittedSet:
    """The set around a given parameter vector; epsilon isn't calibrated yet.  known has the sums at it, if they are."""
    theta = np.asarray(theta, float)
    if theta.shape != (spec.d,):
        raise ValueError(f"theta must have length {spec.d}")
    s = known or sums(frame, spec.d, config.estimator, theta)
    hessian = s.second / s.n + config.lam * np.eye(spec.d)
    linear = config.estimator == "linear"
    cross = None
    if linear:  # first = X'X theta - X'y
        cross = s.second @ theta - s.first
    l_hat = s.loss / s.n + config.lam / 2 * float(theta @ theta)
    return FittedSet(config, spec, frame, s.n, theta, l_hat, hessian, linalg.cholesky(hessian), linalg.condition(hessian), s.least_weight, s.least_margin, s.second if linear else None, cross, s.y2 if linear else None)


def fit(df: DataFrame, spec: FeatureSpec, config: SetConfig | None = None) -> FittedSet:
    """Fit, check the guardrails, calibrate epsilon.  df should be persisted by the caller: each step is a pass."""
    from nearopt.operators.calibrate import calibrated

    config = config or SetConfig()
    frame = spec.project(df, with_label=True)
    share = (lambda n: config.lam) if config.fit_scale == "sum" else (lambda n: config.lam * n)
    if config.estimator == "linear":
        theta, known = solve_linear(frame, spec.d, share)
    else:
        theta, known = solve_logistic(frame, spec.d, share, config.max_iter)
    out = at(frame, spec, config, theta, known)
    guard(out)
    return calibrated(out)


def guard(fitted: FittedSet) -> None:
    """Raises if the classes are nearly separated or the Hessian is ill-conditioned, unless overridden."""
    problem = ""
    if fitted.config.estimator == "logistic" and fitted.least_weight < LEAST_WEIGHT:
        problem = f"near separation: a row has p (1 - p) = {fitted.least_weight:.2g}"
    elif fitted.kappa > MOST_CONDITION:
        problem = f"the Hessian's condition number is {fitted.kappa:.2g}"
    if problem and not fitted.config.safety_override:
        raise RuntimeError(f"{problem}; penalise more, scale the features, or set safety_override")
    if problem:
        warnings.warn(problem, stacklevel=2)
