"""How the models of the set treat groups of rows: rates by group for every draw, and how far gaps between groups range."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.operators import oracle
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix

RATES = ("selection_rate", "true_positive_rate", "false_positive_rate", "accuracy")
#: Counts that a task holds at once; it sends what it has beyond.
HELD = 1 << 21


def counts(fitted: FittedSet, df: DataFrame, by: str, batch, taus: Sequence[float] = (0.0,)) -> DataFrame:
    """(group, tau, sample_id, n, positives, selected, true_positives): rows of each group, those labelled 1, those that a
    draw labels 1 (margin at or above tau), and those of both.

    One pass: a task counts for all draws and thresholds at once, and only counts are shuffled, however common a group
    is.  Null is a group of its own; groups come as text.
    """
    batch, d, taus = oracle.thetas(batch, fitted.d), fitted.d, [float(t) for t in taus]
    k, spec = len(batch), fitted.spec
    rows = spec.project(df, with_label=True, carry=(by,)).withColumn("group", F.col(f"`{by}`").cast("string")).select(*[f"x{j}" for j in range(d)], "y", "group")
    most = max(1, HELD // (2 * k * len(taus)))
    draws, at = np.tile(np.arange(k), len(taus)), np.repeat(taus, k)

    def task(batches):
        held: dict[str | None, list] = {}

        def sent():
            for group, (n, positives, found) in held.items():
                flat = found.reshape(-1, 2)
                m = len(flat)
                columns = [pa.array([group] * m, pa.string()), pa.array(at), pa.array(draws), pa.array(np.full(m, n)), pa.array(np.full(m, positives)), pa.array(flat[:, 0]), pa.array(flat[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["group", "tau", "sample_id", "n", "positives", "selected", "true_positives"])
            held.clear()

        for part in batches:
            x, y = matrix(part, d), part.column(d).to_numpy(zero_copy_only=False) > 0.5
            codes = part.column(d + 1).dictionary_encode(null_encoding="encode")
            names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for a in range(0, len(x), 4096):
                margins = x[a : a + 4096] @ batch.T
                for g in np.unique(of[a : a + 4096]):
                    own = of[a : a + 4096] == g
                    entry = held.setdefault(names[g], [0, 0, np.zeros((len(taus), k, 2), np.int64)])
                    yes = y[a : a + 4096][own]
                    entry[0] += int(own.sum())
                    entry[1] += int(yes.sum())
                    for t, tau in enumerate(taus):
                        ones = margins[own] >= tau
                        entry[2][t, :, 0] += ones.sum(0)
                        entry[2][t, :, 1] += ones[yes].sum(0)
                if len(held) > most:
                    yield from sent()
        yield from sent()

    names = ("n", "positives", "selected", "true_positives")
    out = rows.mapInArrow(task, "group string, tau double, sample_id long, n long, positives long, selected long, true_positives long")
    return out.groupBy("group", "tau", F.col("sample_id").cast("int").alias("sample_id")).agg(*[F.sum(c).alias(c) for c in names])


def rates(counted: DataFrame) -> DataFrame:
    """counts with selection_rate, true_positive_rate, false_positive_rate and accuracy; a rate of no rows is null."""
    share = lambda a, b: F.when(b > 0, a / b)
    n, p, s, t = (F.col(c) for c in ("n", "positives", "selected", "true_positives"))
    return counted.withColumns({"selection_rate": share(s, n), "true_positive_rate": share(t, p), "false_positive_rate": share(s - t, n - p), "accuracy": share(2 * t + n - p - s, n)})


def gaps(counted: DataFrame) -> DataFrame:
    """(tau, sample_id, metric, gap, low_group, high_group): for each draw and rate, the largest difference between two
    groups, and which they are; ties to the first by name, a null name last."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("rate")) for m in RATES])).alias("e")
    rows = rates(counted).select("tau", "sample_id", "group", long).select("tau", "sample_id", "group", "e.*").where("rate is not null")
    name = F.struct(F.col("group").isNull().alias("last"), F.col("group").alias("group"))
    least = F.min(F.struct("rate", name.alias("name")))
    most = F.min(F.struct((-F.col("rate")).alias("rate"), name.alias("name")))
    out = rows.groupBy("tau", "sample_id", "metric").agg(least.alias("a"), most.alias("b"))
    return out.select("tau", "sample_id", "metric", (-F.col("b.rate") - F.col("a.rate")).alias("gap"), F.col("a.name.group").alias("low_group"), F.col("b.name.group").alias("high_group"))


def gap_ranges(fitted: FittedSet, df: DataFrame, by: str, batch, taus: Sequence[float] = (0.0,)) -> DataFrame:
    """(tau, metric, gap_min, gap_max, at_min, at_max): how small and how large the gap between groups is among equally
    good draws, and the draws that have it; ties to the smaller number."""
    found = gaps(counts(fitted, df, by, batch, taus))
    least, most = F.min(F.struct("gap", "sample_id")), F.min(F.struct((-F.col("gap")).alias("gap"), F.col("sample_id")))
    out = found.groupBy("tau", "metric").agg(least.alias("a"), most.alias("b"))
    return out.select("tau", "metric", F.col("a.gap").alias("gap_min"), (-F.col("b.gap")).alias("gap_max"), F.col("a.sample_id").alias("at_min"), F.col("b.sample_id").alias("at_max"))
