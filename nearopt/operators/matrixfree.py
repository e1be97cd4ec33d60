"""Products with the Hessian, and solves by them, without ever holding it: for sets of many features.

Each product is one pass over the rows: a task sums its rows' share of X' W X v, and d numbers a vector are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.config import FeatureSpec, SetConfig
from nearopt.functions import expressions as E
from nearopt.operators import linalg
from nearopt.operators.stats import matrix


def _weights(estimator: str, margins: np.ndarray) -> np.ndarray:
    if estimator == "linear":
        return np.ones_like(margins)
    p = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
    return p * (1 - p)


def hessian_products(frame: DataFrame, estimator: str, theta, lam: float, vectors) -> np.ndarray:
    """H v of each vector, for the mean loss at theta with penalty lam, over a frame (key, x0 ..); (k, d) or (d,)."""
    theta = np.asarray(theta, float)
    batch = np.atleast_2d(np.asarray(vectors, float))
    k, d = batch.shape
    if len(theta) != d:
        raise ValueError(f"vectors must have length {len(theta)}")

    def task(batches):
        out, n = np.zeros((k, d)), 0
        for rows in batches:
            x = matrix(rows, d)
            for a in range(0, len(x), 8192):
                part = x[a : a + 8192]
                out += (_weights(estimator, part @ theta)[:, None] * (part @ batch.T)).T @ part
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * d + 1)), pa.array(np.append(out.ravel(), n))], ["k", "v"])

    sums = np.zeros(k * d + 1)
    for row in frame.mapInArrow(task, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # k * d + 1 rows
        sums[row.k] = row.v
    if not sums[-1]:
        raise ValueError("there are no rows")
    out = sums[:-1].reshape(k, d) / sums[-1] + lam * batch
    return out[0] if np.ndim(vectors) == 1 else out


def preconditioner(frame: DataFrame, estimator: str, theta, lam: float) -> np.ndarray:
    """The diagonal preconditioner of the Hessian, from one pass over sums of columns."""
    margin = E.dot(theta)
    w = E.sigmoid(margin) * (1 - E.sigmoid(margin)) if estimator == "logistic" else F.lit(1.0)
    row = frame.agg(*[F.avg(w * x * x).alias(f"h{j}") for j, x in enumerate(E.columns(len(theta)))]).first()
    return linalg.preconditioner(np.array([row[f"h{j}"] for j in range(len(theta))]) + lam)


def solve(df: DataFrame, spec: FeatureSpec, config: SetConfig, theta, b, precondition: bool = True, tol: float = 1e-6, max_iter: int | None = None) -> np.ndarray:
    """H^-1 b by conjugate gradients, a pass over the rows for each step."""
    frame = spec.project(df, with_label=False)
    diagonal = preconditioner(frame, config.estimator, theta, config.lam) if precondition else None
    return linalg.conjugate_gradients(lambda v: hessian_products(frame, config.estimator, theta, config.lam, v), np.asarray(b, float), diagonal, tol, max_iter or 2 * spec.d + 10)


def inverse_norm(df: DataFrame, spec: FeatureSpec, config: SetConfig, theta, s, **how) -> float:
    """sqrt(s' H^-1 s): what an interval of s . theta is as wide as, by conjugate gradients."""
    s = np.asarray(s, float)
    return float(np.sqrt(max(s @ solve(df, spec, config, theta, s, **how), 0.0)))


def inverse_root(df: DataFrame, spec: FeatureSpec, config: SetConfig, theta, vectors, steps: int | None = None, tol: float = 1e-8) -> np.ndarray:
    """H^-1/2 v of each vector, (k, d) or (d,), by Lanczos' method: the directions that make the set round, without H.

    All vectors take their steps together, one pass over the rows for each; a vector's basis is kept orthogonal to all of
    itself.  What is known after a step is |v| Q T^-1/2 e1, T being the projected Hessian of as many dimensions as steps;
    a vector is done when that changes by less than tol, when its space is exhausted, or after `steps` (d + 10).  The
    driver holds k times steps vectors.
    """
    frame = spec.project(df, with_label=False)
    v = np.atleast_2d(np.asarray(vectors, float))
    k, d = v.shape
    size = np.linalg.norm(v, axis=1)
    out = np.zeros((k, d))
    basis = np.zeros((1, k, d))
    basis[0] = v / np.where(size > 0, size, 1.0)[:, None]
    alpha, beta, going = np.zeros((0, k)), np.zeros((0, k)), size > 0
    for step in range(d + 10 if steps is None else steps):
        if not going.any():
            break
        w = np.zeros((k, d))
        w[going] = hessian_products(frame, config.estimator, theta, config.lam, basis[-1][going])
        alpha = np.append(alpha, [(w * basis[-1]).sum(1)], 0)
        for _ in range(2):  # twice is enough
            w = w - np.einsum("skd,sk->kd", basis, np.einsum("skd,kd->sk", basis, w))
        length = np.linalg.norm(w, axis=1)
        beta = np.append(beta, [length], 0)
        for i in np.flatnonzero(going):
            t = np.diag(alpha[:, i]) + np.diag(beta[:-1, i], 1) + np.diag(beta[:-1, i], -1)
            values, q = np.linalg.eigh(t)
            new = size[i] * (q * np.maximum(values, 1e-300) ** -0.5 @ q[0]) @ basis[:, i]
            change = np.linalg.norm(new - out[i])
            out[i] = new
            going[i] = change > tol * np.linalg.norm(new) and length[i] > 1e-12 * np.abs(values).max() and step + 1 < d
        basis = np.append(basis, [w / np.where(length > 0, length, 1.0)[:, None]], 0)
    return out[0] if np.ndim(vectors) == 1 else out
