"""One object for a near-optimal set: fit, then ask.  Each method is a thin call of an operator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from nearopt.config import FeatureSpec, SetConfig
from nearopt.operators import certify, covering, diagnose, ensemble, groups, importance, multiplicity, oracle, reliance_bounds, shapley, validity
from nearopt.operators import fit as fitting
from nearopt.operators import sample as drawing


class NearOptimalSet:
    """All models of a GLM whose penalised loss is within epsilon of the fitted one.

    NearOptimalSet(epsilon=0.05).fit(df, features, label, key).ambiguity(df)
    """

    def __init__(self, **params):
        self.config = SetConfig(**params)
        self.fitted: fitting.FittedSet | None = None
        self._sampled: dict | None = None

    def fit(self, df: DataFrame, features, label: str, key: str | None = None) -> NearOptimalSet:
        """Fits; on an error the former state stays whole."""
        self.fitted = fitting.fit(df, FeatureSpec(tuple(features), label, key), self.config)
        self._sampled = None
        return self

    def _set(self) -> fitting.FittedSet:
        if self.fitted is None:
            raise RuntimeError("call fit() first")
        return self.fitted

    @staticmethod
    def from_ensemble(models: DataFrame, df: DataFrame, features, label: str, key: str | None = None, **params) -> ensemble.EnsembleSet:
        """The set of the models of a table (model_id, theta) that are within a share epsilon of the best on df."""
        return ensemble.from_ensemble(models, df, FeatureSpec(tuple(features), label, key), SetConfig(**params))

    # parameters
    def get_params(self, deep: bool = True) -> dict:
        return self.config.as_dict()

    def set_params(self, **params) -> NearOptimalSet:
        """Changed parameters hold from the next fit on; the present fit is dropped."""
        self.config, self.fitted, self._sampled = self.config.replace(**params), None, None
        return self

    @property
    def coef_(self) -> np.ndarray:
        return self._set().theta.copy()

    @property
    def n_features_in_(self) -> int:
        return self._set().d

    # membership
    def objective(self, theta, *, margins: DataFrame | None = None) -> float:
        return oracle.objective(self._set(), theta, margins)

    def objective_many(self, batch, *, margins: DataFrame | None = None) -> np.ndarray:
        return oracle.objective_many(self._set(), batch, margins)

    def loss_gap(self, theta, *, margins: DataFrame | None = None) -> float:
        return oracle.loss_gap(self._set(), theta, margins)

    def loss_gap_many(self, batch, *, margins: DataFrame | None = None) -> np.ndarray:
        return oracle.loss_gap_many(self._set(), batch, margins)

    def contains(self, theta, atol: float = oracle.ATOL, *, margins: DataFrame | None = None) -> bool:
        return oracle.contains(self._set(), theta, atol, margins)

    def contains_many(self, batch, atol: float = oracle.ATOL, *, margins: DataFrame | None = None) -> np.ndarray:
        return oracle.contains_many(self._set(), batch, atol, margins)

    # certificates and predictions
    def hacking_interval(self, s) -> dict[str, float]:
        lo, hi = certify.interval(self._set(), s)
        return {"min": lo, "max": hi}

    def coef_intervals(self, indices=None) -> DataFrame:
        return certify.coef_intervals(self._set(), indices)

    def probability_bands(self, df: DataFrame) -> DataFrame:
        return certify.bands(self._set(), df)

    def decision_function(self, df: DataFrame) -> DataFrame:
        return certify.decision_function(self._set(), df)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return certify.predict_proba(self._set(), df)

    def predict(self, df: DataFrame) -> DataFrame:
        return certify.predict(self._set(), df)

    def score(self, df: DataFrame) -> float:
        return certify.score(self._set(), df)

    def diagnostics(self) -> DataFrame:
        return certify.diagnostics(self._set(), self._sampled)

    # sampling
    def sample(self, n_samples: int = 100, **how) -> np.ndarray:
        return drawing.sample(self._set(), n_samples, **how)

    def sample_ellipsoid(self, n_samples: int = 100, random_state: int | None = None, **how) -> np.ndarray:
        return drawing.ellipsoid(self._set(), n_samples, random_state, **how)

    def sample_hitandrun(self, n_samples: int = 100, *, compute_diagnostics: bool = True, **how) -> DataFrame:
        rows = drawing.hit_and_run(self._set(), n_samples, **how)
        if compute_diagnostics:
            # The draws are few: once taken they are a table of their own, and nothing stays persisted.
            rows = rows.sparkSession.createDataFrame(rows.collect(), drawing.SCHEMA)
            self._sampled = self.compute_sample_diagnostics(rows).first().asDict()
        return rows

    def compute_sample_diagnostics(self, samples, *, burnin: int = 0, compute_ess: bool = True, compute_isotropy: bool = True) -> DataFrame:
        return diagnose.sample_diagnostics(self._set(), samples, burnin, compute_ess, compute_isotropy)

    # importance
    def variable_importance_cloud(self, **how) -> DataFrame:
        return importance.cloud(self._set(), **how)

    def variable_importance(self, mode: str = "VIC", **how) -> DataFrame:
        if mode.upper() != "VIC":
            raise NotImplementedError("only VIC")
        return self.variable_importance_cloud(**how)

    def model_class_reliance(self, df: DataFrame, **how) -> DataFrame:
        """A row per feature; model_class_reliance_matrix has the values of each draw."""
        return importance.reliance_summary(importance.reliance(self._set(), df, **how), self._set().spec)

    def model_class_reliance_matrix(self, df: DataFrame, **how) -> DataFrame:
        return importance.reliance(self._set(), df, **how)

    def reliance_bounds(self, df: DataFrame, **how) -> DataFrame:
        """A row per feature: the least and the largest reliance of any model of the set, and these models."""
        return reliance_bounds.bounds(self._set(), df, **how)

    def shapley_values(self, df: DataFrame, **how) -> DataFrame:
        """A row per feature; shapley_matrix has the values of each draw."""
        return shapley.summary(shapley.shapley(self._set(), df, **how), self._set().spec)

    def shapley_matrix(self, df: DataFrame, **how) -> DataFrame:
        return shapley.shapley(self._set(), df, **how)

    # the set's shape
    def trust_region(self, share: float = 0.1) -> DataFrame:
        return validity.trust_region(self._set(), share)

    def covering(self, df: DataFrame, samples=None, n_samples: int = 100, **how) -> DataFrame:
        return covering.capacity(self._set(), df, self.sample(n_samples) if samples is None else samples, **how)

    def row_capacity(self, df: DataFrame, **how) -> DataFrame:
        return covering.row_capacity(self._set(), df, **how)

    def group_gaps(self, df: DataFrame, by: str, samples=None, n_samples: int = 100, taus=(0.0,)) -> DataFrame:
        """The range of each rate's gap between groups among the draws."""
        return groups.gap_ranges(self._set(), df, by, self.sample(n_samples) if samples is None else samples, taus)

    def mixing(self, samples: DataFrame, seconds: float | None = None) -> DataFrame:
        return diagnose.mixing(samples, seconds)

    def trust_fraction(self, samples, share: float = 0.1) -> float:
        return diagnose.trust_fraction(self._set(), samples, share)

    # multiplicity
    def compute_threshold(self, df: DataFrame | None = None, mode: str = "fixed", value: float | None = None, **how) -> float:
        return multiplicity.threshold(self._set(), df, mode, value, **how)

    def ambiguity(self, df: DataFrame, **how) -> DataFrame:
        return multiplicity.ambiguity(self._set(), df, **how)

    def discrepancy(self, df: DataFrame, **how) -> DataFrame:
        return multiplicity.discrepancy(self._set(), df, **how)

    def capacity(self) -> DataFrame:
        return multiplicity.capacity(self._set())

    def multiplicity(self, df: DataFrame, **how) -> dict[str, DataFrame]:
        return multiplicity.multiplicity(self._set(), df, **how)

    # the data behind charts
    def plot_vic(self, **how) -> DataFrame:
        return self.variable_importance_cloud(**how)

    def plot_ambiguity(self, df: DataFrame, tau: float = 0.0, bins: int = 30) -> DataFrame:
        return multiplicity.margin_histogram(self._set(), df, tau, bins)

    def plot_discrepancy(self, df: DataFrame, samples=None, n_samples: int = 20, tau: float = 0.0) -> DataFrame:
        return multiplicity.disagreement_rows(self._set(), df, self.sample(n_samples) if samples is None else samples, tau)
