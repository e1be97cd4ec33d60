"""Capacity of the set as a covering: how few of its models stand for all, by the labels they give; and row by row, as
the capacity of the channel from models to scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.functions import expressions as E
from nearopt.operators import certify, oracle
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix

#: Rows whose labels are packed together, and most draws: pairs are counted for all of them, half of this squared.
ROWS, MOST = 8192, 2048


def signatures(labels: np.ndarray) -> np.ndarray:
    """Labels (rows x draws) as bits: a row of 64-bit words for each draw."""
    bits = np.packbits(labels, axis=0, bitorder="little")
    words = -(-len(bits) // 8)
    return np.ascontiguousarray(np.pad(bits, ((0, words * 8 - len(bits)), (0, 0))).T).view(np.uint64)


def differing(fitted: FittedSet, df: DataFrame, batch, tau: float = 0.0) -> tuple[np.ndarray, int]:
    """On how many rows each two draws give other labels (margin at or above tau), and the number of rows.

    A task packs the labels of its rows into bits, 64 rows a word, and counts the bits in which two draws differ; only
    these counts are shuffled, and added up.
    """
    batch = oracle.thetas(batch, fitted.d)
    k, d = len(batch), fitted.d
    if k > MOST:
        raise ValueError(f"at most {MOST} draws")
    a, b = np.triu_indices(k, 1)

    def task(batches):
        out, n = np.zeros((k, k), np.int64), 0
        for rows in batches:
            x = matrix(rows, d)
            for at in range(0, len(x), ROWS):
                bits = signatures(x[at : at + ROWS] @ batch.T >= tau)
                n += len(x[at : at + ROWS])
                for i in range(k - 1):
                    out[i, i + 1 :] += np.bitwise_count(bits[i] ^ bits[i + 1 :]).sum(1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a) + 1)), pa.array(np.append(out[a, b], n))], ["k", "v"])

    rows = fitted.spec.project(df, with_label=False).mapInArrow(task, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a number a pair
    flat = np.zeros(len(a) + 1, np.int64)
    for r in rows:
        flat[r.k] = r.v
    out = np.zeros((k, k), np.int64)
    out[a, b] = out[b, a] = flat[:-1]
    return out, int(flat[-1])


def farthest(counts: np.ndarray) -> list[tuple[int, int]]:
    """(draw, radius) in the order of farthest-point traversal from draw 0: each draw taken is the farthest from those
    before it, ties to the smaller number; radius is the largest distance left once it is taken.  It ends at radius 0.

    The first k draws cover all within their radius; that is at most twice what any k could do.
    """
    near = counts[0].copy()
    out = [(0, int(near.max()))]
    while out[-1][1] > 0:
        far = int(near.argmax())
        np.minimum(near, counts[far], out=near)
        out.append((far, int(near.max())))
    return out


def traversal(fitted: FittedSet, df: DataFrame, batch, tau: float = 0.0) -> DataFrame:
    """(k, sample_id, radius): the draws in covering order, and the share of rows within which the first k cover all."""
    counts, n = differing(fitted, df, batch, tau)
    return df.sparkSession.createDataFrame([(k + 1, i, r / max(n, 1)) for k, (i, r) in enumerate(farthest(counts))], "k int, sample_id int, radius double")


def capacity(fitted: FittedSet, df: DataFrame, batch, deltas: Sequence[float] = (0.0, 0.01, 0.05, 0.1), tau: float = 0.0) -> DataFrame:
    """(delta, covering_number, radius, capacity) for each delta: how many draws of the traversal cover all draws within
    delta, a share of the rows; their radius; and the number's logarithm to base 2.  These draws are pairwise more than
    delta apart, so no covering within delta / 2 has fewer."""
    counts, n = differing(fitted, df, batch, tau)
    order, out = farthest(counts), []
    for delta in deltas:
        k = next(k for k, (_, r) in enumerate(order, 1) if r <= delta * n)
        out.append((float(delta), k, order[k - 1][1] / max(n, 1), math.log2(k)))
    return df.sparkSession.createDataFrame(out, "delta double, covering_number int, radius double, capacity double")


def _entropy(p: Column) -> Column:
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(F.lit(0.0))
    return part(p) + part(1 - p)


def row_capacity(fitted: FittedSet, df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(key, p_lo, p_hi, capacity, *carry): of each row, the capacity in bits of the channel whose input is a model of the
    set's ellipsoid and whose output the label drawn from its score: 0 where all models give one score, 1 at most.

    Scores of a row fill a range, and the capacity of such a channel is that of its two ends, which is known in closed
    form.  No shuffle; logistic models only.
    """
    if fitted.config.estimator != "logistic":
        raise NotImplementedError("scores need a logistic model")
    rows = certify.scored(fitted, df, carry).select("key", E.sigmoid(F.col("lo")).alias("p_lo"), E.sigmoid(F.col("hi")).alias("p_hi"), *carry)
    a, b = F.col("p_lo"), F.col("p_hi")
    rows = rows.withColumns({"_a": _entropy(a), "_b": _entropy(b)})
    bits = (a * F.col("_b") - b * F.col("_a")) / (b - a) + F.log2(1 + F.pow(F.lit(2.0), (F.col("_a") - F.col("_b")) / (b - a)))
    return rows.select("key", "p_lo", "p_hi", F.when(b - a > 1e-9, F.greatest(bits, F.lit(0.0))).otherwise(F.lit(0.0)).alias("capacity"), *carry)
