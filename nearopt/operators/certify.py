"""Predictions and certificates: what all models of the set agree on, row by row, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.functions import expressions as E
from nearopt.operators.fit import FittedSet

DIAGNOSTICS = "estimator string, n long, d int, lambda double, l_hat double, theta_norm double, epsilon double, epsilon_mode string, calibration string, implied_alpha double, measure string, seed long, kappa double, least_weight double, least_margin double, set_fidelity double, isotropy_ratio double, engine string, theta array<double>"


def interval(fitted: FittedSet, s) -> tuple[float, float]:
    """Range of s . theta over the set's ellipsoid."""
    s = np.asarray(s, float)
    if s.shape != (fitted.d,):
        raise ValueError(f"s must have length {fitted.d}")
    centre, half = float(s @ fitted.theta), fitted.reach * float(np.linalg.norm(fitted.inverse_factor @ s))
    return centre - half, centre + half


def coef_intervals(fitted: FittedSet, indices=None) -> DataFrame:
    """A row per coefficient: j, feature, theta_hat, lo, hi, width, certain (the sign is the same throughout)."""
    indices = range(fitted.d) if indices is None else [int(j) for j in indices]
    if any(not 0 <= j < fitted.d for j in indices):
        raise ValueError(f"indices must be in 0 .. {fitted.d - 1}")
    rows = []
    for j in indices:
        lo, hi = interval(fitted, np.eye(fitted.d)[j])
        rows.append((j, fitted.spec.columns[j], float(fitted.theta[j]), lo, hi, hi - lo, lo > 0 or hi < 0))
    return fitted.frame.sparkSession.createDataFrame(rows, "j int, feature string, theta_hat double, lo double, hi double, width double, certain boolean")


def margin(fitted: FittedSet) -> Column:
    return E.dot(fitted.theta)


def half_width(fitted: FittedSet) -> Column:
    return F.lit(fitted.reach) * E.norm(fitted.inverse_factor)


def scored(fitted: FittedSet, df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(key, [y,] margin, lo, hi, *carry): each row's margin and its range over the ellipsoid, with columns of df that
    come along.  Works on streams as well."""
    rows = fitted.spec.project(df, with_label=None if fitted.spec.label in df.columns else False, carry=carry)
    keep = [c for c in ("key", "y") if c in rows.columns]
    rows = rows.select(*keep, *carry, margin(fitted).alias("margin"), half_width(fitted).alias("half"))
    return rows.select(*keep, "margin", (F.col("margin") - F.col("half")).alias("lo"), (F.col("margin") + F.col("half")).alias("hi"), *carry)


def bands(fitted: FittedSet, df: DataFrame, tau: float = 0.0) -> DataFrame:
    """key, margin, lo, hi, p, p_lo, p_hi, ambiguous: probabilities and their ranges, logistic models only."""
    if fitted.config.estimator != "logistic":
        raise NotImplementedError("probabilities need a logistic model")
    s = E.sigmoid
    return scored(fitted, df).select("key", "margin", "lo", "hi", s(F.col("margin")).alias("p"), s(F.col("lo")).alias("p_lo"), s(F.col("hi")).alias("p_hi"), ((F.col("lo") <= tau) & (F.col("hi") >= tau)).alias("ambiguous"))


def decision_function(fitted: FittedSet, df: DataFrame) -> DataFrame:
    return scored(fitted, df).select("key", "margin")


def _label(fitted: FittedSet):
    """1 where the margin is above 0; for linear models the margin."""
    return (F.col("margin") > 0).cast("double") if fitted.config.estimator == "logistic" else F.col("margin")


def predict_proba(fitted: FittedSet, df: DataFrame) -> DataFrame:
    return bands(fitted, df).select("key", (1.0 - F.col("p")).alias("p0"), F.col("p").alias("p1"))


def predict(fitted: FittedSet, df: DataFrame) -> DataFrame:
    """key, prediction: 1 where the margin is above 0; for linear models the margin."""
    return scored(fitted, df).select("key", _label(fitted).alias("prediction"))


def predictions(fitted: FittedSet, df: DataFrame) -> DataFrame:
    """key, prediction, p0, p1: predict and predict_proba in one pass."""
    return bands(fitted, df).select("key", _label(fitted).alias("prediction"), (1.0 - F.col("p")).alias("p0"), F.col("p").alias("p1"))


def score(fitted: FittedSet, df: DataFrame) -> float:
    """Accuracy, or R squared; of a constant target 1 if it is met exactly, else 0."""
    rows = fitted.spec.project(df, with_label=True).select("y", margin(fitted).alias("m"))
    if fitted.config.estimator == "logistic":
        return rows.agg(F.avg(((F.col("m") > 0).cast("double") == F.col("y")).cast("double"))).first()[0]
    residual, total = rows.agg(F.sum((F.col("y") - F.col("m")) ** 2), F.var_pop("y") * F.count("y")).first()
    return 1 - residual / total if total > 0 else float(residual <= 0)


def diagnostics(fitted: FittedSet, sampled: dict | None = None) -> DataFrame:
    """One row on the fit, with the fidelity and isotropy of a sampling if its diagnostics are given."""
    spark, c, sampled = fitted.frame.sparkSession, fitted.config, sampled or {}
    row = (c.estimator, fitted.n, fitted.d, fitted.lam, fitted.l_hat, float(np.linalg.norm(fitted.theta)), fitted.epsilon, c.epsilon_mode, fitted.calibration, fitted.alpha, c.measure, c.random_state, fitted.kappa, fitted.least_weight, fitted.least_margin, sampled.get("set_fidelity"), sampled.get("isotropy_ratio"), f"spark {spark.version}", [float(t) for t in fitted.theta])
    return spark.createDataFrame([row], DIAGNOSTICS)
