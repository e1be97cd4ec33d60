"""Objective and membership of parameter vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.functions import expressions as E
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix

#: Slack of membership in the public calls.
ATOL = 1e-12


def thetas(values, d: int) -> np.ndarray:
    """A batch of parameter vectors as a (k, d) array."""
    out = np.atleast_2d(np.asarray(values, float))
    if out.ndim != 2 or out.shape[1] != d:
        raise ValueError(f"parameter vectors must have length {d}")
    return out


def objective(fitted: FittedSet, theta, margins: DataFrame | None = None) -> float:
    """Mean loss and penalty of one vector; margins (margin, y), if given, saves the products."""
    theta = np.asarray(theta, float)
    if theta.shape != (fitted.d,):
        raise ValueError(f"theta must have length {fitted.d}")
    if margins is None:
        return float(objective_many(fitted, theta[None])[0])
    kind = fitted.config.estimator
    return margins.agg(F.avg(E.loss(kind, F.col("margin"), F.col("y")))).first()[0] + fitted.lam / 2 * float(theta @ theta)


def objective_many(fitted: FittedSet, batch, margins: DataFrame | None = None) -> np.ndarray:
    """Objectives of k vectors in one pass over the rows; for linear models from second moments, without a pass.

    margins, if given, is a table (sample_id, margin, y) with scores that are known already.
    """
    batch = thetas(batch, fitted.d)
    penalty = fitted.lam / 2 * (batch * batch).sum(1)
    if margins is not None:
        rows = margins.groupBy("sample_id").agg(F.avg(E.loss(fitted.config.estimator, F.col("margin"), F.col("y"))).alias("loss")).collect()
        found = {r.sample_id: r.loss for r in rows}
        return np.array([found[i] for i in range(len(batch))]) + penalty
    if fitted.config.estimator == "linear":
        quadratic = np.einsum("ki,ij,kj->k", batch, fitted.gram, batch)
        return (fitted.y2 - 2 * batch @ fitted.cross + quadratic) / (2 * fitted.n) + penalty
    return _loss_sums(fitted.frame, batch, fitted.d) / fitted.n + penalty


def _loss_sums(frame: DataFrame, batch: np.ndarray, d: int) -> np.ndarray:
    """Summed logistic loss of each vector: a partial sum per task, then one small aggregate."""

    def task(batches):
        total = np.zeros(len(batch))
        for rows in batches:
            x, y = matrix(rows, d), rows.column(rows.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            for a in range(0, len(y), 4096):
                m = x[a : a + 4096] @ batch.T
                total += (np.logaddexp(0.0, m) - y[a : a + 4096, None] * m).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), pa.array(total)], ["sample_id", "loss"])

    rows = frame.mapInArrow(task, "sample_id long, loss double").groupBy("sample_id").agg(F.sum("loss").alias("loss")).collect()
    out = np.zeros(len(batch))
    for r in rows:
        out[r.sample_id] = r.loss
    return out


def loss_gap(fitted: FittedSet, theta, margins: DataFrame | None = None) -> float:
    return objective(fitted, theta, margins) - fitted.l_hat


def loss_gap_many(fitted: FittedSet, batch, margins: DataFrame | None = None) -> np.ndarray:
    return objective_many(fitted, batch, margins) - fitted.l_hat


def contains(fitted: FittedSet, theta, atol: float = ATOL, margins: DataFrame | None = None) -> bool:
    return loss_gap(fitted, theta, margins) <= fitted.epsilon + atol


def contains_many(fitted: FittedSet, batch, atol: float = ATOL, margins: DataFrame | None = None) -> np.ndarray:
    return loss_gap_many(fitted, batch, margins) <= fitted.epsilon + atol


def membership(fitted: FittedSet, batch, atol: float = ATOL) -> DataFrame:
    """A row per vector: sample_id, objective, loss_gap, inside."""
    values = objective_many(fitted, batch)
    rows = [(i, float(v), float(v - fitted.l_hat), bool(v - fitted.l_hat <= fitted.epsilon + atol)) for i, v in enumerate(values)]
    return fitted.frame.sparkSession.createDataFrame(rows, "sample_id int, objective double, loss_gap double, inside boolean")


def samples_frame(spark, batch) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.atleast_2d(batch))], "sample_id int, theta array<double>")


def members(fitted: FittedSet, batch, atol: float = ATOL) -> DataFrame:
    """The vectors inside the set: sample_id, theta."""
    inside = membership(fitted, batch, atol).where("inside").select("sample_id")
    return samples_frame(fitted.frame.sparkSession, batch).join(inside, "sample_id", "left_semi")


def worst_member(fitted: FittedSet, batch, share: float) -> tuple[float, bool]:
    """Largest objective of a batch, and whether it is within (1 + share) of the fitted one."""
    worst = float(objective_many(fitted, batch).max())
    return worst, worst <= (1 + share) * fitted.l_hat + 1e-9
