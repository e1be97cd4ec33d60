"""Thresholds, ambiguous rows, disagreement between equally good models, and summaries over the set."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.functions import expressions as E
from nearopt.functions.order import order_statistics, quantiles
from nearopt.operators import certify, oracle
from nearopt.operators import sample as draw
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix

MODES = ("fixed", "match_prevalence", "match_fpr", "youden")
METRICS = ("ambiguity", "discrepancy", "capacity")


# ------------------------------------------------------------------------------------------------- thresholds
def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def threshold(fitted: FittedSet, df: DataFrame | None = None, mode: str = "fixed", value: float | None = None, fpr: float = 0.05) -> float:
    """A threshold on margins.

    fixed: logit of `value` (0.5).  match_prevalence: logit of the labels' mean.  match_fpr: the margin of the
    labelled negatives of df below which a share 1 - fpr of them lies.  youden: of the percentiles 1 .. 99 of the
    margins, the first with the largest sensitivity + specificity - 1, where margins at the threshold count as 1.
    """
    if fitted.config.estimator != "logistic":
        raise ValueError("thresholds need a logistic model")
    if mode not in MODES:
        raise ValueError(f"threshold mode must be one of {', '.join(MODES)}")
    if mode == "fixed":
        value = 0.5 if value is None else float(value)
        if not 0 < value < 1:
            raise ValueError("value must be in (0, 1)")
        return _logit(value)
    if df is None:
        raise ValueError(f"{mode} needs labelled rows")
    rows = fitted.spec.project(df, with_label=True).select("y", certify.margin(fitted).alias("margin"))
    if mode == "match_prevalence":
        rate = rows.agg(F.avg("y")).first()[0]
        if rate is None or not 0 < rate < 1:
            warnings.warn("every label is the same, so no rate can be matched: 0 is used", stacklevel=2)
            return 0.0
        return _logit(rate)
    if mode == "match_fpr":
        negatives = rows.where("y = 0")
        n = negatives.count()
        if not n:
            warnings.warn("no row is labelled 0, so no rate of false alarms can be set: 0 is used", stacklevel=2)
            return 0.0
        return order_statistics(negatives, "margin", [int((1 - fpr) * n)])[0]
    out = youden_table(rows).orderBy(F.desc("j"), "i").first()
    return 0.0 if out is None else out.tau


def _place(x: Column, cuts: Sequence[float], low: int = 0, high: int | None = None) -> Column:
    """How many of the ascending cuts are at or below x, by halving."""
    high = len(cuts) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x >= F.lit(float(cuts[middle])), _place(x, cuts, middle + 1, high)).otherwise(_place(x, cuts, low, middle))


def youden_table(rows: DataFrame) -> DataFrame:
    """(i, tau, j) for the 99 percentiles of the margins of rows (y, margin).

    Each row is counted once, among the percentiles that it lies between; the rest are sums over these 100 counts."""
    found = [(i, t) for i, t in enumerate(quantiles(rows, "margin", [i / 100 for i in range(1, 100)])) if t is not None]
    schema = "i int, tau double, j double"
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    cuts = sorted({t for _, t in found})
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    of = {r.at: (r.p, r.n) for r in rows.groupBy(_place(F.col("margin"), cuts).alias("at")).agg(hit(F.col("y") == 1).alias("p"), hit(F.col("y") == 0).alias("n")).collect()}  # 100 rows
    ones, zeros = (np.array([of.get(k, (0, 0))[side] for k in range(len(cuts) + 1)]) for side in (0, 1))
    out = []
    for i, tau in found:
        k = cuts.index(tau) + 1  # margins at or above tau have a place from here on
        rate = lambda part, whole: part / whole if whole else 0.0
        out.append((i, tau, float(rate(ones[k:].sum(), ones.sum()) + rate(zeros[:k].sum(), zeros.sum()) - 1.0)))
    return rows.sparkSession.createDataFrame(out, schema)


# ------------------------------------------------------------------------------------------------- multiplicity
def ambiguous(fitted: FittedSet, df: DataFrame, tau: float, carry: Sequence[str] = ()) -> DataFrame:
    """(key, margin, lo, hi, *carry, ambiguous): rows whose margins' range holds the threshold, ends included."""
    return certify.scored(fitted, df, carry).select("key", "margin", "lo", "hi", *carry, ((F.col("lo") <= tau) & (F.col("hi") >= tau)).alias("ambiguous"))


def ambiguity(fitted: FittedSet, df: DataFrame, threshold_mode: str = "fixed", threshold_value: float | None = None, **how) -> DataFrame:
    """One row: ambiguity_rate, n_ambiguous, threshold."""
    tau = threshold(fitted, df, threshold_mode, threshold_value, **how)
    hits = F.col("ambiguous").cast("double")
    return ambiguous(fitted, df, tau).agg(F.coalesce(F.avg(hits), F.lit(0.0)).alias("ambiguity_rate"), F.coalesce(F.sum(hits), F.lit(0.0)).cast("long").alias("n_ambiguous"), F.lit(tau).alias("threshold"))


def ambiguous_keys(fitted: FittedSet, df: DataFrame, tau: float) -> DataFrame:
    return ambiguous(fitted, df, tau).where("ambiguous").select("key")


def _shares_of(rows: DataFrame, cases: dict[tuple, Column], names: Sequence[str]) -> DataFrame:
    """(*names, ambiguity_rate): for each case the share of rows that meet its condition; a sum for each, and no copies of
    rows.  No rows give none."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(f"c{k}") for k, c in enumerate(cases.values())])
    each = [F.struct(*[F.lit(v).alias(name) for v, name in zip(case, names)], F.col(f"c{k}").alias("ambiguity_rate")) for k, case in enumerate(cases)]
    return out.where("n > 0").select(F.explode(F.array(*each)).alias("e")).select("e.*")


def sweep(fitted: FittedSet, df: DataFrame, shares, tau: float = 0.0) -> DataFrame:
    """(rho, epsilon, ambiguity_rate) for several tolerances, in one pass: the half width scales with the root."""
    rows = fitted.spec.project(df, with_label=False).select(F.abs(certify.margin(fitted) - tau).alias("away"), E.norm(fitted.inverse_factor).alias("unit"))
    cases = {(float(r), float(r) * fitted.l_hat): F.col("away") <= math.sqrt(2 * float(r) * fitted.l_hat) * F.col("unit") for r in shares}
    return _shares_of(rows, cases, ("rho", "epsilon"))


def threshold_sweep(fitted: FittedSet, df: DataFrame, modes=MODES) -> DataFrame:
    """(mode, tau, ambiguity_rate) for several ways to set the threshold, in one pass over the rows."""
    taus = {(m, threshold(fitted, df, m)): None for m in modes}
    return _shares_of(certify.scored(fitted, df), {(m, t): (F.col("lo") <= t) & (F.col("hi") >= t) for m, t in taus}, ("mode", "tau"))


def joint_counts(fitted: FittedSet, df: DataFrame, batch: np.ndarray, tau: float) -> tuple[np.ndarray, int]:
    """How often two draws both label a row 1 (margin at or above the threshold), for all pairs; and the rows.

    Each task sums the products of its rows' labels; only these k by k sums are shuffled.
    """
    k, d = len(batch), fitted.d

    def task(batches):
        out, n = np.zeros((k, k)), 0
        for rows in batches:
            x = matrix(rows, d)
            for a in range(0, len(x), 8192):
                labels = (x[a : a + 8192] @ batch.T >= tau).astype(np.float32)
                out += labels.T @ labels
                n += len(labels)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + 1)), pa.array(np.append(out.ravel(), n))], ["k", "v"])

    rows = fitted.spec.project(df, with_label=False).mapInArrow(task, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k * k + 1)
    for r in rows:
        flat[r.k] = r.v
    return flat[:-1].reshape(k, k), int(flat[-1])


def disagreement(fitted: FittedSet, df: DataFrame, batch, tau: float = 0.0) -> np.ndarray:
    """Share of the rows that two draws label differently, for all pairs."""
    both, n = joint_counts(fitted, df, oracle.thetas(batch, fitted.d), tau)
    own = np.diag(both)
    return (own[:, None] + own[None, :] - 2 * both) / max(n, 1)


def disagreement_rows(fitted: FittedSet, df: DataFrame, batch, tau: float = 0.0) -> DataFrame:
    """(a, b, disagreement) of the whole matrix."""
    m = disagreement(fitted, df, batch, tau)
    return fitted.frame.sparkSession.createDataFrame([(a, b, float(m[a, b])) for a in range(len(m)) for b in range(len(m))], "a int, b int, disagreement double")


def random_pairs(k: int, n_pairs: int, seed: int | None) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    return [tuple(int(x) for x in rng.choice(k, 2, replace=False)) for _ in range(n_pairs)]


def discrepancy(fitted: FittedSet, df: DataFrame, samples=None, n_samples: int = 100, n_pairs: int = 50, threshold_mode: str = "fixed", threshold_value: float | None = None, random_state: int | None = None, pairs=None, **how) -> DataFrame:
    """One row: discrepancy_bound (share of ambiguous rows), discrepancy_empirical and mean_pair_disagreement (mean over
    pairs of draws), max_pair_disagreement, threshold.  With fewer than two draws the empirical fields are null."""
    tau = threshold(fitted, df, threshold_mode, threshold_value, **how)
    seed = fitted.config.random_state if random_state is None else random_state
    batch = draw.sample(fitted, n_samples, random_state=seed) if samples is None else oracle.thetas(samples, fitted.d)
    bound = ambiguous(fitted, df, tau).agg(F.coalesce(F.avg(F.col("ambiguous").cast("double")), F.lit(0.0))).first()[0]
    spark, schema = fitted.frame.sparkSession, "discrepancy_bound double, discrepancy_empirical double, max_pair_disagreement double, mean_pair_disagreement double, threshold double"
    if len(batch) < 2:
        warnings.warn("fewer than two draws", stacklevel=2)
        return spark.createDataFrame([(bound, None, None, None, tau)], schema)
    m = disagreement(fitted, df, batch, tau)
    found = [float(m[a, b]) for a, b in (pairs or random_pairs(len(batch), n_pairs, seed))]
    mean = float(np.mean(found))
    return spark.createDataFrame([(bound, mean, max(found), mean, tau)], schema)


def capacity(fitted: FittedSet) -> DataFrame:
    """One row: log_volume, effective_dim, log_det_hessian."""
    volume, dim, ld = draw.log_volume(fitted)
    return fitted.frame.sparkSession.createDataFrame([(volume, float(dim), ld)], "log_volume double, effective_dim double, log_det_hessian double")


def multiplicity(fitted: FittedSet, df: DataFrame, which=("ambiguity", "discrepancy"), samples=None, n_samples: int = 100, threshold_mode: str = "fixed", threshold_value: float | None = None, n_pairs: int = 50, random_state: int | None = None, fpr: float = 0.05) -> dict[str, DataFrame]:
    """The metrics named, each a frame of one row."""
    unknown = [m for m in which if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    out = {}
    if "ambiguity" in which:
        out["ambiguity"] = ambiguity(fitted, df, threshold_mode, threshold_value, fpr=fpr)
    if "discrepancy" in which:
        out["discrepancy"] = discrepancy(fitted, df, samples, n_samples, n_pairs, threshold_mode, threshold_value, random_state, fpr=fpr)
    if "capacity" in which:
        out["capacity"] = capacity(fitted)
    return out


# ------------------------------------------------------------------------------------------------- summaries
def margin_histogram(fitted: FittedSet, df: DataFrame, tau: float = 0.0, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n, n_ambiguous) over equal bins of the margins; the last is closed, empty ones are left out."""
    rows = ambiguous(fitted, df, tau)
    low, high = rows.agg(F.min("margin"), F.max("margin")).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_ambiguous")).limit(0)
    width = (high - low) / bins
    at = F.least(F.lit(bins), F.floor((F.col("margin") - low) / width).cast("int") + 1) if width > 0 else F.lit(1)
    out = rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("ambiguous").cast("long")).alias("n_ambiguous"))
    return out.select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("lo"), (F.lit(low) + F.col("bin") * width).alias("hi"), "n", "n_ambiguous")


def ensemble(fitted: FittedSet, df: DataFrame, batch) -> DataFrame:
    """(key, [y,] p, p_ensemble): the fitted model's probability and the mean over draws."""
    batch = oracle.thetas(batch, fitted.d)
    rows = fitted.spec.project(df, with_label=None if fitted.spec.label in df.columns else False)
    keep = [c for c in ("key", "y") if c in rows.columns]
    d = fitted.d

    def task(batches):
        for part in batches:
            m = matrix(part, d)
            mean = np.zeros(len(m))
            for a in range(0, len(m), 4096):
                mean[a : a + 4096] = (1 / (1 + np.exp(-np.clip(m[a : a + 4096] @ batch.T, -700, 700)))).mean(1)
            p = 1 / (1 + np.exp(-np.clip(m @ fitted_theta, -700, 700)))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], pa.array(p), pa.array(mean)], [*keep, "p", "p_ensemble"])

    fitted_theta = fitted.theta
    types = dict(rows.dtypes)
    return rows.mapInArrow(task, ", ".join([f"{c} {types[c]}" for c in keep] + ["p double", "p_ensemble double"]))


def quality(rows: DataFrame) -> DataFrame:
    """Log loss and accuracy of the fitted model and of the ensemble, from rows (y, p, p_ensemble)."""
    y = F.col("y")
    ce = lambda p: F.avg(-(y * F.log(F.greatest(F.lit(1e-15), p)) + (1 - y) * F.log(F.greatest(F.lit(1e-15), 1 - p))))
    ok = lambda p: F.avg(((p > 0.5).cast("double") == y).cast("double"))
    p, q = F.col("p"), F.col("p_ensemble")
    return rows.agg(ce(p).alias("logloss_point"), ce(q).alias("logloss_ensemble"), ok(p).alias("accuracy_point"), ok(q).alias("accuracy_ensemble"))


def coefficient_distance(a: FittedSet, b: FittedSet) -> float:
    return float(np.linalg.norm(a.theta - b.theta))
