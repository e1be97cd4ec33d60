"""Calibrating epsilon."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearopt.operators import highdim, linalg
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix

#: Share of the loss that is used where a mode can't be.
FALLBACK = 0.05
SEED = 123456789
GOLDEN = 0.6180339887498949


def _clipped(share: float, name: str) -> float:
    if 0.0 < share < 1.0:
        return share
    warnings.warn(f"{name} expects epsilon in (0, 1); it is clipped", stacklevel=3)
    return min(max(share, 1e-12), 1 - 1e-12)


def calibrated(fitted: FittedSet) -> FittedSet:
    """fitted with epsilon by the mode of its configuration."""
    c = fitted.config
    if c.epsilon_mode == "percent_loss":
        return fitted.with_epsilon(_clipped(c.epsilon, "percent_loss") * fitted.l_hat, None, "percent_loss")
    if c.epsilon_mode == "LR_alpha_highdim":
        found = highdim.correction(fitted) if c.estimator == "logistic" else None
        if found is None:
            why = "the classes can be told apart with so many features" if c.estimator == "logistic" else "the correction is for logistic models"
            warnings.warn(f"{why}; 5 % of the loss is used", stacklevel=2)
            return fitted.with_epsilon(FALLBACK * fitted.l_hat, None, "fallback")
        alpha = _clipped(c.epsilon, "LR_alpha_highdim")
        return fitted.with_epsilon(found["factor"] * wilks(fitted, alpha).epsilon, alpha, "highdim")
    alpha = _clipped(c.epsilon, "LR_alpha")
    if c.safety_override:
        return wilks(fitted, alpha)
    if not c.bootstrap_fallback:
        warnings.warn("penalised fits don't meet the conditions of the likelihood ratio; 5 % of the loss is used", stacklevel=2)
        return fitted.with_epsilon(FALLBACK * fitted.l_hat, None, "fallback")
    if c.estimator != "logistic":
        warnings.warn("the bootstrap is for logistic models; 5 % of the loss is used", stacklevel=2)
        return fitted.with_epsilon(FALLBACK * fitted.l_hat, None, "fallback")
    return fitted.with_epsilon(bootstrap(fitted, alpha), alpha, "bootstrap")


def wilks(fitted: FittedSet, alpha: float) -> FittedSet:
    """Half the chi-square quantile over n."""
    return fitted.with_epsilon(0.5 * linalg.chi2_quantile(1 - alpha, fitted.d) / fitted.n, alpha, "wilks")


def _uniform(keys: np.ndarray, replicates: np.ndarray, seed: int, numbers: str) -> np.ndarray:
    """A number in [0, 1) for each key (row) and replicate (column), from these alone, so partitions don't matter: a
    counter hash, or an even number."""
    if numbers == "even":
        x = keys.astype(float)[:, None] * (1.0 + 3.0 * replicates) * GOLDEN
        return x - np.floor(x)
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (replicates + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed & (2**63 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _replicate_sums(fitted: FittedSet, keyed, batch: np.ndarray, base: np.ndarray, seed: int, numbers: str) -> tuple[np.ndarray, ...]:
    """Of each replicate at its vector: loss, gradient and Hessian sums, and the loss at the fitted vector."""
    reps, d = batch.shape
    upper = np.triu_indices(d)
    width = 2 + d + len(upper[0])
    rows_at_once = max(16, min(2048, (1 << 22) // (reps + len(upper[0]))))

    def task(batches):
        out, which = np.zeros((reps, width)), np.arange(reps)
        for rows in batches:
            x, keys = matrix(rows, d), rows.column(rows.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            for a in range(0, len(keys), rows_at_once):
                z, k = x[a : a + rows_at_once], keys[a : a + rows_at_once]
                m0, m = z @ base, z @ batch.T
                p0 = 1 / (1 + np.exp(-np.clip(m0, -700, 700)))
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                y = (_uniform(k, which, seed, numbers) < p0[:, None]).astype(float)
                out[:, 0] += (np.logaddexp(0.0, m) - y * m).sum(0)
                out[:, 1] += np.logaddexp(0.0, m0).sum() - m0 @ y
                out[:, 2 : 2 + d] += (p - y).T @ z
                out[:, 2 + d :] += (p * (1 - p)).T @ (z[:, upper[0]] * z[:, upper[1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps * width)), pa.array(out.ravel())], ["k", "v"])

    rows = keyed.mapInArrow(task, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # reps * width rows
    flat = np.zeros(reps * width)
    for r in rows:
        flat[r.k] = r.v
    flat = flat.reshape(reps, width)
    hessian = np.zeros((reps, d, d))
    hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = flat[:, 2 + d :]
    return flat[:, 0], flat[:, 1], flat[:, 2 : 2 + d], hessian


def bootstrap(fitted: FittedSet, alpha: float, steps: int = 40, numbers: str = "random") -> float:
    """Parametric bootstrap of the likelihood ratio: labels drawn from the fitted model, all replicates refitted
    together by Newton steps that share their passes; (1 - alpha) quantile of 2 n (L_b(theta) - L_b(theta_b)), over 2 n.

    Draws depend on the seed, the replicate and the row's key, or without a key the hash of its features; numbers = "even"
    draws even numbers by a numeric key instead, which other engines can repeat.
    """
    c, n, d = fitted.config, fitted.n, fitted.d
    reps = max(int(c.bootstrap_reps), 10)
    seed = SEED if c.random_state is None else int(c.random_state)
    xs = [f"x{j}" for j in range(d)]
    if numbers == "even" and fitted.spec.key is None:
        raise ValueError("even numbers need a key")
    key = F.col("key").cast("long") if numbers == "even" else F.xxhash64("key", *xs) if fitted.spec.key is None else F.xxhash64("key")
    keyed = fitted.frame.select(key.alias("key"), *xs)
    share = c.lam / n if c.fit_scale == "sum" else c.lam
    batch = np.tile(fitted.theta, (reps, 1))
    best, best_value = batch.copy(), np.full(reps, np.inf)
    base = None
    step = np.zeros_like(batch)
    for _ in range(steps):
        loss, loss0, gradient, hessian = _replicate_sums(fitted, keyed, batch, fitted.theta, seed, numbers)
        base = loss0
        value = loss / n + share / 2 * (batch * batch).sum(1)
        worse = value > best_value + 1e-13
        better = ~worse
        best[better], best_value[better] = batch[better], value[better]
        g = gradient / n + share * batch
        moving = better & (np.abs(g).max(1) > 1e-11)
        step[worse] /= 2
        step[moving] = -np.linalg.solve(hessian[moving] / n + share * np.eye(d), g[moving][:, :, None])[:, :, 0]
        done = ~moving & ~worse | (np.abs(step).max(1) < 1e-12)
        if done.all():
            break
        batch = np.where(done[:, None], best, best + step)
    value_hat = base / n + c.lam / 2 * float(fitted.theta @ fitted.theta)
    refit = best_value - share / 2 * (best * best).sum(1) + c.lam / 2 * (best * best).sum(1)
    ratios = 2 * n * np.maximum(value_hat - refit, 0.0)
    return float(np.quantile(ratios, 1 - alpha) / (2 * n))
