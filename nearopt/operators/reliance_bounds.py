"""The least and the largest reliance on a feature that any model of the set has, by optimisation instead of draws.

Permuting a feature changes only its own products with the other features and with the label, so one pass over the
permuted rows gives their second moments, and the reliance of every linear model follows from them: a quadratic form,
whose extremes over an ellipsoid are a trust-region problem of d dimensions.  For logistic models the reliance is the
rise of the mean log loss.  It is the difference of two convex functions, whose quadratic minorant or majorant is taken
at the current vector, as is a majorant of the objective, which is an ellipsoid inside the set; so each step is a
trust-region problem again, stays in the exact set, and never makes the value worse.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.operators import importance, oracle
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix, sums
from nearopt.storage import dropped, written

SETS = ("ellipsoid", "exact")
SCHEMA = "j int, feature string, reliance_min double, reliance_max double, at_min array<double>, at_max array<double>, passes int"


def minimum_in_ball(b: np.ndarray, g: np.ndarray, r: float) -> np.ndarray:
    """The u with |u| <= r that makes u'bu / 2 + g'u least; b is symmetric, of either sign.

    In the eigenvectors of b the minimum is u = -g / (values + m) for the least m >= 0 that makes b + m positive and |u|
    no longer than r: the secular equation.  Where g has no part along the least value, what is missing to the length r
    is added along it.
    """
    values, q = np.linalg.eigh(b)
    h = q.T @ g
    size = max(1.0, float(np.abs(values).max(initial=0.0)), float(np.linalg.norm(h)))
    least = max(0.0, -float(values[0]))
    at = lambda m: np.where(np.abs(h) > 1e-15 * size, -h / np.where(values + m == 0, 1e-300, values + m), 0.0)
    if values[0] > 0 and np.linalg.norm(at(0.0)) <= r:
        return q @ at(0.0)
    low_space = np.abs(values - values[0]) <= 1e-13 * size
    if values[0] <= 0 and np.linalg.norm(h[low_space]) <= 1e-14 * size:  # the hard case, unless the rest is too long
        u = np.where(low_space, 0.0, -h / np.where(low_space, 1.0, values + least))
        rest = r * r - float(u @ u)
        if rest >= 0:
            if values[0] < 0:
                u[0] += math.sqrt(rest)
            return q @ u
    low, high = least, least + float(np.linalg.norm(h)) / max(r, 1e-300) + 1e-300
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if np.linalg.norm(at(middle)) > r else (low, middle)
    return q @ at(high)


def _extreme(a: np.ndarray, b: np.ndarray, centre: np.ndarray, hessian: np.ndarray, r: float, sign: int) -> np.ndarray:
    """The vector within r of the centre, under the hessian, that makes sign * (t'at - 2b't) least."""
    inverse = np.linalg.solve(np.linalg.cholesky(hessian), np.eye(len(b)))  # L^-1; t = centre + L^-T u
    u = minimum_in_ball(2 * sign * inverse @ a @ inverse.T, 2 * sign * inverse @ (a @ centre - b), r)
    return centre + inverse.T @ u


def permuted_moments(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (j, y, x, xp): the means of xp with each feature (a row of d for each j) and with the label."""
    own = [F.avg(F.col("xp") * F.element_at("x", k + 1)) for k in range(d)]
    out, label = np.zeros((d, d)), np.zeros(d)
    for r in rows.groupBy("j").agg(F.avg(F.col("xp") * F.col("y")), *own).collect():  # d rows
        out[r[0]], label[r[0]] = r[2:], r[1]
    return out, label


def forms(gram: np.ndarray, cross: np.ndarray, moved: np.ndarray, moved_label: np.ndarray, var: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(a, b) for each feature: the reliance of t on it is t'at - 2b't."""
    out = []
    for j in range(len(cross)):
        a, b = np.zeros_like(gram), np.zeros_like(cross)
        a[j] = a[:, j] = (moved[j] - gram[j]) / var
        a[j, j] = 0.0  # a permutation moves the values, and their squares with them
        b[j] = (moved_label[j] - cross[j]) / var
        out.append((a, b))
    return out


def bounds(fitted: FittedSet, df: DataFrame, n_permutations: int = 16, over: str = "ellipsoid", starts=None, order=None, random_state: int | None = None, max_iter: int = 60, tol: float = 1e-9) -> DataFrame:
    """A row per feature: j, feature, reliance_min, reliance_max, at_min, at_max (the models that have them), passes.

    The permutations are those of importance.reliance with the same order or seed, so a linear set's bounds hold every
    value that it finds among draws of the ellipsoid.  Linear models: the fall of R squared, over the set's ellipsoid or,
    with over="exact", over the set itself, which is an ellipsoid around the objective's own minimum; both exactly.
    Logistic models: the rise of the mean log loss, always over the exact set; steps start from the best of the fitted
    vector and the members among `starts`, and end, each direction for itself, when one gains less than tol or max_iter
    passes are made: what they reach is held by a member of the set, and no start is better.
    """
    if over not in SETS:
        raise ValueError(f"over must be one of {', '.join(SETS)}")
    spec, d = fitted.spec, fitted.d
    frame = spec.project(df, with_label=True)
    seed = fitted.config.random_state if random_state is None else random_state
    rows = importance.permuted(frame, d, "iid", n_permutations, order, 0 if seed is None else int(seed))
    at0 = sums(frame, d, "linear", np.zeros(d))
    gram, cross = at0.second / at0.n, -at0.first / at0.n
    if fitted.config.estimator == "logistic":
        table = written(rows.select("j", "y", "x", "xp"), "permuted")  # each step reads it
        try:
            found = _logistic(fitted, frame, table, gram, starts, max_iter, tol)
        finally:
            dropped(table)
    else:
        var = frame.agg(F.var_pop("y")).first()[0]
        if not var > 0:
            raise ValueError("the label doesn't vary")
        centre, r = fitted.theta, fitted.reach
        if over == "exact":
            own = fitted.gram / fitted.n + fitted.lam * np.eye(d)
            centre = np.linalg.solve(own, fitted.cross / fitted.n)
            r = math.sqrt(2 * fitted.epsilon + float((fitted.theta - centre) @ own @ (fitted.theta - centre)))
        found = []
        for a, b in forms(gram, cross, *permuted_moments(rows, d), var):
            ends = [_extreme(a, b, centre, fitted.hessian, r, sign) for sign in (1, -1)]
            found.append(([float(t @ a @ t - 2 * b @ t) for t in ends], ends, 1))
    out = [(j, spec.columns[j], lo, hi, [float(v) for v in at_lo], [float(v) for v in at_hi], passes) for j, ((lo, hi), (at_lo, at_hi), passes) in enumerate(found)]
    return df.sparkSession.createDataFrame(out, SCHEMA)


def _losses(frame: DataFrame, table: DataFrame, batch: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each vector and its feature: mean log loss and gradient on the rows, and the same on the permuted rows."""
    k, d = batch.shape

    def sent(out, n):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size + len(n))), pa.array(np.append(out.ravel(), n))], ["i", "v"])

    def measured(x, y, theta):
        m = x @ theta
        return float((np.logaddexp(0.0, m) - y * m).sum()), x.T @ (1 / (1 + np.exp(-np.clip(m, -700, 700))) - y)

    def plain(batches):
        out, n = np.zeros((k, d + 1)), np.zeros(k)
        for part in batches:
            x, y = matrix(part, d), part.column(part.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            n += len(y)
            for i in range(k):
                loss, gradient = measured(x, y, batch[i])
                out[i] += np.append(gradient, loss)
        yield from sent(out, n)

    def moved(batches):
        out, n = np.zeros((k, d + 1)), np.zeros(k)
        for part in batches:
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            j, y, xp = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
            for f in np.unique(j):
                own = j == f
                z = x[own].copy()
                z[:, f] = xp[own]
                for i in np.flatnonzero(features == f):
                    loss, gradient = measured(z, y[own], batch[i])
                    out[i] += np.append(gradient, loss)
                    n[i] += own.sum()
        yield from sent(out, n)

    found = []
    for rows, task in ((frame, plain), (table, moved)):
        flat = np.zeros(k * (d + 2))
        for r in rows.mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # k * (d + 2) numbers
            flat[r.i] = r.v
        means = flat[: k * (d + 1)].reshape(k, d + 1) / np.maximum(flat[k * (d + 1) :, None], 1)
        found += [means[:, d], means[:, :d]]
    return tuple(found)


def _logistic(fitted: FittedSet, frame: DataFrame, table: DataFrame, gram: np.ndarray, starts, max_iter: int, tol: float) -> list:
    d, lam = fitted.d, fitted.lam
    moved, _ = permuted_moments(table, d)
    # A quarter of the second moments bounds the curvature of the log loss anywhere.
    bound, permuted_bounds = gram / 4, []
    for j in range(d):
        m = gram.copy()
        m[j], m[:, j], m[j, j] = moved[j], moved[j], gram[j, j]
        permuted_bounds.append(m / 4)
    curve = bound + lam * np.eye(d)
    factor = np.linalg.cholesky(curve)
    inverse = np.linalg.solve(factor, np.eye(d))
    signs, features = np.tile([1, -1], d), np.repeat(np.arange(d), 2)  # least, largest
    now, passes = np.tile(fitted.theta, (2 * d, 1)), np.ones(2 * d, int)
    objective = lambda loss, t: loss + lam / 2 * (t * t).sum(1) - fitted.l_hat
    if starts is not None:
        batch = oracle.thetas(starts, d)
        many, which = np.tile(batch, (d, 1)), np.repeat(np.arange(d), len(batch))
        r, _, p, _ = _losses(frame, table, np.concatenate([many, fitted.theta[None].repeat(d, 0)]), np.append(which, np.arange(d)))
        inside = objective(r[: len(many)], many) <= fitted.epsilon
        for i in range(2 * d):
            own = np.flatnonzero((which == features[i]) & inside)
            best = own[np.argmin(signs[i] * (p - r)[own])] if len(own) else None
            if best is not None and signs[i] * (p - r)[best] < signs[i] * (p - r)[len(many) + features[i]]:
                now[i] = many[best]
    value, going = None, np.ones(2 * d, bool)
    for _ in range(max_iter):
        r, r_slope, p, p_slope = _losses(frame, table, now[going], features[going])
        gap, ids = objective(r, now[going]), np.flatnonzero(going)
        fresh = p - r
        value = np.full(2 * d, np.nan) if value is None else value
        gained = np.isnan(value[ids]) | (np.abs(fresh - value[ids]) > tol * (1 + np.abs(fresh)))
        value[ids] = fresh
        passes[ids] += 1
        for n, i in enumerate(ids):
            if not gained[n]:
                going[i] = False
                continue
            slope = r_slope[n] + lam * now[i]
            centre = -inverse.T @ (inverse @ slope)
            left = 2 * (fitted.epsilon - gap[n]) + float((inverse @ slope) @ (inverse @ slope))
            h = permuted_bounds[features[i]] if signs[i] > 0 else bound
            g = signs[i] * (p_slope[n] - r_slope[n])
            u = minimum_in_ball(inverse @ h @ inverse.T, inverse @ (h @ centre + g), math.sqrt(max(left, 0.0)))
            now[i] = now[i] + centre + inverse.T @ u
        if not going.any():
            break
    if going.any():  # the last step's value
        r, _, p, _ = _losses(frame, table, now[going], features[going])
        value[going] = p - r
    return [(value[2 * j : 2 * j + 2].tolist(), [now[2 * j], now[2 * j + 1]], int(passes[2 * j : 2 * j + 2].max())) for j in range(d)]
