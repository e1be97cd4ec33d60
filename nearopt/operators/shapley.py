"""Shapley values of the features for every draw of the set: how a model's score is shared out among its features.

A coalition's value is the score of the model that knows only its features, the others being held at their means.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.config import FeatureSpec
from nearopt.functions.expressions import columns
from nearopt.operators import oracle
from nearopt.operators import sample as draw
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix, sums

SCORES = ("log_likelihood", "accuracy")
#: Features up to which all coalitions are valued; beyond, orders of the features are drawn.
EXACT = 6
#: Values of margins that a task holds at once.
HELD = 1 << 21
SCHEMA = "sample_id int, j int, value double, std_error double"


def moments(frame: DataFrame, d: int) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """(n, means of the features, mean label, their covariances, those with the label, the label's variance)."""
    row = frame.agg(*[F.avg(x) for x in columns(d)], F.avg("y"), F.var_pop("y")).first()
    at0 = sums(frame, d, "linear", np.zeros(d))
    mean, y = np.array(row[:d], float), row[d]
    return at0.n, mean, y, at0.second / at0.n - np.outer(mean, mean), -at0.first / at0.n - mean * y, row[d + 1]


def _linear(frame: DataFrame, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, empty, full): R squared of a coalition is a quadratic form of its indicator, so each feature's value is
    its own part and half of what it shares with each other one; second moments have it all."""
    _, mean, y, cov, cross, var = moments(frame, batch.shape[1])
    if not var > 0:
        raise ValueError("the label doesn't vary")
    values = (2 * batch * cross - batch * (batch @ cov)) / var
    empty = -((y - batch @ mean) ** 2) / var
    return values, empty, empty + values.sum(1)


def gray(d: int) -> list[int]:
    """The feature flipped at each step of a walk through all subsets of d features."""
    return [(k & -k).bit_length() - 1 for k in range(1, 1 << d)]


def walks(d: int, pairs: int, seed: int) -> list[list[int]]:
    """Orders of the features, each followed by its reverse."""
    rng = np.random.default_rng(seed)
    firsts = [rng.permutation(d).tolist() for _ in range(pairs)]
    return [w for first in firsts for w in (first, first[::-1])]


def coalition_values(frame: DataFrame, batch: np.ndarray, mean: np.ndarray, paths: list[list[int]], score: str) -> dict[int, np.ndarray]:
    """By coalition (bits of its features), the mean score of each draw; paths start from no feature and flip one a step.
    One pass: a task walks the paths with the margins of some rows for all draws, and sends a sum for each coalition and
    draw."""
    k, d = batch.shape
    steps, index = [], {0: 0}
    for path in paths:
        at, own = 0, []
        for j in path:
            at ^= 1 << j
            own.append((j, 1.0 if at >> j & 1 else -1.0, index.setdefault(at, len(index)), at))
        steps.append(own)
    centre = batch @ mean
    width = max(1, HELD // k)

    def scored(m: np.ndarray, y: np.ndarray) -> np.ndarray:
        if score == "accuracy":
            return ((m > 0) == (y[:, None] > 0.5)).sum(0).astype(float)
        return (y[:, None] * m - np.logaddexp(0.0, m)).sum(0)

    def task(batches):
        out, n = np.zeros((len(index), k)), 0
        for rows in batches:
            x, y = matrix(rows, d) - mean, rows.column(rows.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            for a in range(0, len(y), width):
                z, own = x[a : a + width], y[a : a + width]
                n += len(own)
                start = np.tile(centre, (len(own), 1))
                out[0] += scored(start, own)
                seen = {0}
                for path in steps:
                    m = start.copy()
                    for j, sign, i, at in path:
                        m += sign * z[:, j, None] * batch[:, j]
                        if at not in seen:
                            seen.add(at)
                            out[i] += scored(m, own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size + 1)), pa.array(np.append(out.ravel(), n))], ["i", "v"])

    rows = frame.mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a number for each coalition and draw
    flat = np.zeros(len(index) * k + 1)
    for r in rows:
        flat[r.i] = r.v
    if not flat[-1]:
        raise ValueError("there are no rows")
    table = flat[:-1].reshape(-1, k) / flat[-1]
    return {at: table[i] for at, i in index.items()}


def _exact(values: dict[int, np.ndarray], d: int) -> np.ndarray:
    out = np.zeros((len(values[0]), d))
    for at, v in values.items():
        s = at.bit_count()
        for j in range(d):
            if not at >> j & 1:
                out[:, j] += (values[at | 1 << j] - v) / (d * math.comb(d - 1, s))
    return out


def shapley(fitted: FittedSet, df: DataFrame, batch=None, n_samples: int = 100, score: str = "log_likelihood", pairs: int = 32, sampler: str | None = None, random_state: int | None = None) -> DataFrame:
    """(sample_id, j, value, std_error): the share of each feature in each draw's score.

    Linear models: R squared, exactly, from second moments.  Logistic models: the mean log likelihood, or accuracy
    (margin above 0), exactly up to EXACT features; beyond, from `pairs` orders of the features, each with its reverse,
    whose spread over the pairs gives the standard error (null for a single pair).  Values of a draw add up to its
    score less that of the model without features, exactly in all cases.
    """
    spec, d = fitted.spec, fitted.d
    if score not in SCORES:
        raise ValueError(f"score must be one of {', '.join(SCORES)}")
    if pairs < 1:
        raise ValueError("pairs must be at least 1")
    seed = fitted.config.random_state if random_state is None else random_state
    batch = draw.sample(fitted, n_samples, sampler, random_state=seed) if batch is None else oracle.thetas(batch, d)
    frame = spec.project(df, with_label=True)
    error = np.zeros(batch.shape)
    if fitted.config.estimator == "linear":
        values = _linear(frame, batch)[0]
    else:
        mean = np.array(frame.agg(*[F.avg(x) for x in columns(d)]).first(), float)
        if d <= EXACT:
            values = _exact(coalition_values(frame, batch, mean, [gray(d)], score), d)
        else:
            paths = walks(d, pairs, 0 if seed is None else int(seed))
            known = coalition_values(frame, batch, mean, paths, score)
            parts = np.zeros((len(paths), *batch.shape))
            for p, path in enumerate(paths):
                at = 0
                for j in path:
                    parts[p, :, j] = known[at | 1 << j] - known[at]
                    at |= 1 << j
            both = (parts[::2] + parts[1::2]) / 2
            values = both.mean(0)
            error = both.std(0, ddof=1) / math.sqrt(len(both)) if len(both) > 1 else None
    rows = [(i, j, float(values[i, j]), None if error is None else float(error[i, j])) for i in range(len(batch)) for j in range(d)]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def summary(values: DataFrame, spec: FeatureSpec) -> DataFrame:
    """A row per feature over the draws: j, feature, value_mean, value_std, value_min, value_max, std_error (root of the
    mean square)."""
    name = F.element_at(F.array(*[F.lit(c) for c in spec.columns]), F.col("j") + 1)
    v, e = F.col("value"), F.col("std_error")
    out = values.groupBy("j").agg(F.avg(v).alias("value_mean"), F.stddev_pop(v).alias("value_std"), F.min(v).alias("value_min"), F.max(v).alias("value_max"), F.sqrt(F.avg(e * e)).alias("std_error"))
    return out.select("j", name.alias("feature"), "value_mean", "value_std", "value_min", "value_max", "std_error")
