"""Sums over rows that every fit and certificate needs, each in one pass with partial aggregates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.functions import expressions as E
from nearopt.operators.record import observed

#: Features up to which second moments are written out as sums of columns; beyond, tasks sum matrices.
WRITTEN_OUT = 16


@dataclass(frozen=True)
class Sums:
    """n, and the sums of w x x', g x, the loss, and the least of the margin and weight measures."""

    n: int
    second: np.ndarray
    first: np.ndarray
    loss: float
    least_weight: float
    least_margin: float
    y2: float


def _parts(estimator: str, theta):
    margin, y = E.dot(theta), F.col("y")
    if estimator == "logistic":
        p = E.sigmoid(margin)
        return margin, p * (1 - p), p - y, E.loss(estimator, margin, y), (2 * y - 1) * margin
    return margin, F.lit(1.0), margin - y, E.loss(estimator, margin, y), F.lit(None).cast("double")


def sums(frame: DataFrame, d: int, estimator: str, theta: np.ndarray) -> Sums:
    """Sums at theta over a frame (key, x0 .., y): second = sum w x x', first = sum dloss/dmargin x."""
    frame, done = observed(frame)
    out = _sums_by_task(frame, d, estimator, theta) if d > WRITTEN_OUT else _sums_of_columns(frame, d, estimator, theta)
    done()
    return out


def _sums_of_columns(frame: DataFrame, d: int, estimator: str, theta: np.ndarray) -> Sums:
    margin, w, g, loss, signed = _parts(estimator, theta)
    rows = frame.select(*E.columns(d), F.col("y"), w.alias("w"), g.alias("g"), loss.alias("loss"), signed.alias("signed"))
    xs = E.columns(d)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    whole = E.total(xs) + F.col("y")  # null, NaN or infinite if any of them is
    complete = F.when(~F.isnan(whole) & (F.abs(whole) < F.lit(float("inf"))), F.lit(1))
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(complete).alias("whole"),
        F.sum("loss").alias("loss"),
        F.min("w").alias("least_weight"),
        F.min("signed").alias("least_margin"),
        F.sum(F.col("y") * F.col("y")).alias("y2"),
        *[F.sum(F.col("g") * xs[j]).alias(f"g{j}") for j in range(d)],
        *[F.sum(F.col("w") * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in pairs],
    ).first()
    _checked(out.n, out.whole)
    second = np.zeros((d, d))
    for i, j in pairs:
        second[i, j] = second[j, i] = out[f"h{i}_{j}"]
    return Sums(out.n, second, np.array([out[f"g{j}"] for j in range(d)]), out.loss, out.least_weight, out.least_margin, out.y2)


def _checked(n: int, whole: int) -> None:
    if not n:
        raise ValueError("there are no rows")
    if n != whole:
        raise ValueError(f"{n - whole} rows have a null or non-finite feature or label")


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The columns x0 .. of a batch as rows of a matrix."""
    return np.stack([batch.column(batch.schema.get_field_index(f"x{j}")).to_numpy(zero_copy_only=False) for j in range(d)], 1) if d else np.empty((batch.num_rows, 0))


def _sums_by_task(frame: DataFrame, d: int, estimator: str, theta: np.ndarray) -> Sums:
    theta, upper = np.asarray(theta, float), np.triu_indices(d)

    def task(batches):
        h, g = np.zeros((d, d)), np.zeros(d)
        n = whole = 0
        loss = y2 = 0.0
        least_w, least_m = np.inf, np.inf
        for batch in batches:
            x, y = matrix(batch, d), batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)
            ok = np.isfinite(x).all(1) & np.isfinite(y)
            n, whole = n + len(y), whole + int(ok.sum())
            x, y = x[ok], y[ok]
            m = x @ theta
            if estimator == "logistic":
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                w, r, signed = p * (1 - p), p - y, (2 * y - 1) * m
                loss += float((np.logaddexp(0, m) - y * m).sum())
                least_m = min(least_m, signed.min(initial=np.inf))
            else:
                w, r = np.ones(len(y)), m - y
                loss += float(0.5 * (r * r).sum())
            least_w = min(least_w, w.min(initial=np.inf))
            h += (x * w[:, None]).T @ x
            g += x.T @ r
            y2 += float(y @ y)
        names = np.arange(len(upper[0]) + d + 4)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([h[upper], g, [loss, y2, n, whole]])), pa.array(np.where(names == 0, least_w, np.where(names == 1, least_m, np.inf)))], ["k", "v", "least"])

    rows = frame.mapInArrow(task, "k long, v double, least double").groupBy("k").agg(F.sum("v").alias("v"), F.min("least").alias("least"))
    out = {r.k: r for r in rows.collect()}  # half of d * d rows
    if not out:
        raise ValueError("there are no rows")
    v, m = np.array([out[k].v for k in range(len(out))]), len(upper[0])
    _checked(int(v[-2]), int(v[-1]))
    second = np.zeros((d, d))
    second[upper] = v[:m]
    second.T[upper] = v[:m]
    return Sums(int(v[-2]), second, v[m : m + d], v[-4], out[0].least, out[1].least if estimator == "logistic" else None, v[-3])
