"""Queries of fits, single calls, samplers and the estimator's surface, each beside the same in SQL."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.api import NearOptimalSet
from nearopt.config import FeatureSpec, SetConfig
from nearopt.functions.even import even_steps
from nearopt.operators import calibrate, certify, diagnose, importance, matrixfree, multiplicity, oracle
from nearopt.operators import fit as fitting
from nearopt.operators import sample as draw
from nearopt.plans import catalog as C
from nearopt.sources import tables
from nearopt.storage import new_path
from nearopt.streaming import scoring

#: Chains, draws of all chains, and moves before them, of the walk that SQL repeats.
CHAINS, WALKED, BURNIN = 2, 24, 5
REPLICATES, ALPHA = 10, 0.2
V = (1.0, -2.0)


# ------------------------------------------------------------------------------------------------- SQL of fitted sets
def _newton(penalty: str, steps: int = 15) -> str:
    """Newton's steps from 0 on z; penalty is an expression for the penalty against the summed loss of n rows."""
    p = "1 / (1 + exp(-(t0 * x0 + t1 * x1)))"
    return f"""{C.Z}, steps(it, t0, t1) AS (SELECT 0, 0.0e0, 0.0e0 UNION ALL
SELECT it + 1, t0 - ((b11 * g0 - b01 * g1) / (b00 * b11 - b01 * b01)), t1 - ((b00 * g1 - b01 * g0) / (b00 * b11 - b01 * b01)) FROM (
SELECT it, t0, t1, sum(({p} - y) * x0) + {penalty} * t0 AS g0, sum(({p} - y) * x1) + {penalty} * t1 AS g1, sum({p} * (1 - {p}) * x0 * x0) + {penalty} AS b00, sum({p} * (1 - {p}) * x0 * x1) AS b01, sum({p} * (1 - {p}) * x1 * x1) + {penalty} AS b11 FROM steps, z WHERE it < {steps} GROUP BY it, t0, t1) q),
th AS (SELECT t0, t1 FROM steps WHERE it = {steps})"""


def _fitted(lam: float, rho: float) -> str:
    """The set around the fit of the documents, as C.SET is around the stated vector."""
    return f"""{_newton(f"{lam}e0")}, mm AS (SELECT z.*, t0, t1, t0 * x0 + t1 * x1 AS margin FROM z, th),
pp AS (SELECT *, 1 / (1 + exp(-margin)) AS p, greatest(margin, 0) + ln(1 + exp(-abs(margin))) - y * margin AS loss FROM mm),
hh AS (SELECT count(*) AS n, any_value(t0) AS t0, any_value(t1) AS t1, avg(loss) + 0.5e0 * {lam}e0 * any_value(t0 * t0 + t1 * t1) AS l_hat, avg(p * (1 - p) * x0 * x0) + {lam}e0 AS h00, avg(p * (1 - p) * x0 * x1) AS h01, avg(p * (1 - p) * x1 * x1) + {lam}e0 AS h11, min(p * (1 - p)) AS least_weight, min((2 * y - 1) * margin) AS least_margin FROM pp),
h AS (SELECT *, h00 * h11 - h01 * h01 AS det, {rho}e0 * l_hat AS eps FROM hh),
b AS (SELECT pp.*, h.eps, sqrt(2 * eps) * sqrt((x0 * x0 * h11 - 2 * x0 * x1 * h01 + x1 * x1 * h00) / det) AS half FROM pp, h),
s AS (SELECT *, margin - half AS lo, margin + half AS hi, (margin - half <= 0 AND margin + half >= 0) AS ambiguous FROM b)"""


_BANDS = f"doc_id, {C._r('margin')}, {C._r('lo')}, {C._r('hi')}, {C._r('p')}, round(1 / (1 + exp(-lo)), 6) + 0.0e0 AS p_lo, round(1 / (1 + exp(-hi)), 6) + 0.0e0 AS p_hi, ambiguous FROM s"
_ROOT = "sqrt((h00 - h11) * (h00 - h11) / 4 + h01 * h01)"
_KAPPA = f"((h00 + h11) / 2 + {_ROOT}) / ((h00 + h11) / 2 - {_ROOT})"


def _even(k: str, i: int) -> str:
    x = f"({k}) * {float(even_steps(i + 1)[i])!r}e0"
    return f"({x} - floor({x}))"


def _normal(k: str, j: int) -> str:
    return f"sqrt(-2 * ln({_even(k, 2 * j)})) * cos(2 * pi() * {_even(k, 2 * j + 1)})"


def _ball(n: int) -> str:
    """drawn(sample_id, a0, a1): even draws from the ellipsoid of h around (c0, c1) of centre."""
    return f"""counted AS (SELECT CAST(range AS INTEGER) AS sample_id, CAST(range + 1 AS DOUBLE) AS k FROM range(0, {n})),
normals AS (SELECT sample_id, {_normal("k", 0)} AS g0, {_normal("k", 1)} AS g1, sqrt({_even("k", 4)}) AS r FROM counted),
ball AS (SELECT sample_id, g0 / sqrt(g0 * g0 + g1 * g1) * r * sqrt(2 * eps) AS b0, g1 / sqrt(g0 * g0 + g1 * g1) * r * sqrt(2 * eps) AS b1 FROM normals, centre),
drawn AS (SELECT sample_id, c0 + (b0 - h01 / sqrt(h00) * (b1 / sqrt(h11 - h01 * h01 / h00))) / sqrt(h00) AS a0, c1 + b1 / sqrt(h11 - h01 * h01 / h00) AS a1 FROM ball, centre)"""


_PART_CENTRE = f"{C.PSET}, centre AS (SELECT h00, h01, h11, eps, t0 AS c0, t1 AS c1 FROM h)"


def _walk() -> str:
    """The chains of hit_and_run on the part set: a move is a root of the objective's quadratic on either side."""
    k = f"CAST(chain_id * {draw.APART} + it + 1 AS DOUBLE)"
    steps = BURNIN + WALKED // CHAINS
    return f"""WITH RECURSIVE {C.PSET}, walk(chain_id, it, a0, a1) AS (SELECT CAST(range AS INTEGER), 0, t0, t1 FROM range(0, {CHAINS}), h UNION ALL
SELECT chain_id, it + 1, a0 + (lo + u * (hi - lo)) * v0, a1 + (lo + u * (hi - lo)) * v1 FROM (
SELECT *, (-q1 - sqrt(q1 * q1 - 4 * q2 * q0)) / (2 * q2) AS lo, (-q1 + sqrt(q1 * q1 - 4 * q2 * q0)) / (2 * q2) AS hi FROM (
SELECT *, (y2 - 2 * (a0 * c0 + a1 * c1) + a0 * a0 * g00 + 2 * a0 * a1 * g01 + a1 * a1 * g11) / (2 * n) + 0.5e0 * (a0 * a0 + a1 * a1) - l_hat - eps AS q0,
(v0 * (g00 * a0 + g01 * a1 - c0) + v1 * (g01 * a0 + g11 * a1 - c1)) / n + a0 * v0 + a1 * v1 AS q1,
(v0 * v0 * g00 + 2 * v0 * v1 * g01 + v1 * v1 * g11) / (2 * n) + 0.5e0 * (v0 * v0 + v1 * v1) AS q2 FROM (
SELECT *, w0 / sqrt(w0 * w0 + w1 * w1) AS v0, w1 / sqrt(w0 * w0 + w1 * w1) AS v1 FROM (
SELECT chain_id, it, a0, a1, h.*, {_even(k, 4)} AS u, h11 * ({_normal(k, 0)}) - h01 * ({_normal(k, 1)}) AS w0, h00 * ({_normal(k, 1)}) - h01 * ({_normal(k, 0)}) AS w1 FROM walk, h WHERE it < {steps})))))
SELECT chain_id, CAST(it - {BURNIN + 1} AS INTEGER) AS step, {C._r('a0')}, {C._r('a1')} FROM walk WHERE it > {BURNIN}"""


def _replicates() -> str:
    """The bootstrap of the likelihood ratio with even labels, refits by Newton's steps from the fit."""
    p = "1 / (1 + exp(-(a0 * x0 + a1 * x1)))"
    lam = 100
    step = lambda: f"doc_id * (1.0e0 + 3.0e0 * b) * {calibrate.GOLDEN}e0"
    loss = lambda a0, a1: f"greatest({a0} * x0 + {a1} * x1, 0) + ln(1 + exp(-abs({a0} * x0 + {a1} * x1))) - yb * ({a0} * x0 + {a1} * x1)"
    return f"""WITH RECURSIVE {_newton(f"{lam}e0")},
lab AS (SELECT b, x0, x1, t0, t1, CASE WHEN {step()} - floor({step()}) < 1 / (1 + exp(-(t0 * x0 + t1 * x1))) THEN 1.0e0 ELSE 0.0e0 END AS yb FROM z, th, (SELECT CAST(range AS INTEGER) AS b FROM range(0, {REPLICATES}))),
refit(b, it, a0, a1) AS (SELECT CAST(range AS INTEGER), 0, t0, t1 FROM range(0, {REPLICATES}), th UNION ALL
SELECT b, it + 1, a0 - ((b11 * g0 - b01 * g1) / (b00 * b11 - b01 * b01)), a1 - ((b00 * g1 - b01 * g0) / (b00 * b11 - b01 * b01)) FROM (
SELECT refit.b, it, a0, a1, sum(({p} - yb) * x0) + {lam} * a0 AS g0, sum(({p} - yb) * x1) + {lam} * a1 AS g1, sum({p} * (1 - {p}) * x0 * x0) + {lam} AS b00, sum({p} * (1 - {p}) * x0 * x1) AS b01, sum({p} * (1 - {p}) * x1 * x1) + {lam} AS b11 FROM refit JOIN lab ON lab.b = refit.b WHERE it < 12 GROUP BY refit.b, it, a0, a1) q),
ratio AS (SELECT refit.b, count(*) AS n, 2 * count(*) * greatest(avg({loss('t0', 't1')}) + {lam / 2}e0 * any_value(t0 * t0 + t1 * t1) - avg({loss('a0', 'a1')}) - {lam / 2}e0 * any_value(a0 * a0 + a1 * a1), 0) AS r FROM refit JOIN lab ON lab.b = refit.b WHERE it = 12 GROUP BY refit.b)
SELECT round(quantile_cont(r, {1 - ALPHA}) / (2 * any_value(n)), 6) + 0.0e0 AS epsilon FROM ratio"""


# ------------------------------------------------------------------------------------------------- fits and calibration
def _mean_scale(s, f) -> DataFrame:
    p = fitting.fit(C.documents(s, f), C.DOCS, SetConfig(C=100.0, fit_scale="mean", safety_override=True))
    return C.one_row(s, theta0=float(p.theta[0]), theta1=float(p.theta[1]))


def _wilks(s, f) -> DataFrame:
    p = calibrate.wilks(C.document_set(s, f), 0.05)
    return C.one_row(s, epsilon=p.epsilon * p.n, alpha=p.alpha, calibration=p.calibration)


def _modes(s, f) -> DataFrame:
    """What each mode makes of epsilon, as a share of the loss where it is one."""
    rows = []
    cases = (("percent", "linear", {"epsilon": 0.02}), ("clipped", "linear", {"epsilon": 1.5}), ("linear", "linear", {"epsilon_mode": "LR_alpha", "epsilon": 0.1}), ("highdim", "linear", {"epsilon_mode": "LR_alpha_highdim"}), ("without", "logistic", {"epsilon_mode": "LR_alpha", "epsilon": 0.1, "bootstrap_fallback": False}))
    linear, logistic = C.part_set(s, f), C.document_set(s, f)
    for name, kind, params in cases:
        base = linear if kind == "linear" else logistic
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            p = calibrate.calibrated(fitting.replace(base, config=SetConfig(estimator=kind, **params)))
        rows.append((name, p.epsilon / p.l_hat, p.calibration, p.alpha))
    return C.rounded(s.createDataFrame(rows, "mode string, share double, calibration string, alpha double"))


def _bootstrap(s, f) -> DataFrame:
    p = C.fitted_set(s, f, SetConfig(C=0.01, bootstrap_reps=REPLICATES))
    return C.one_row(s, epsilon=calibrate.bootstrap(p, ALPHA, numbers="even"))


def _raised(call) -> str:
    try:
        call()
    except Exception as e:  # what it raises is the result
        return type(e).__name__
    return "accepted"


def _cases(s, f) -> DataFrame:
    """What wrong arguments raise."""
    p, lin = C.document_set(s, f), C.part_set(s, f)
    docs = C.documents(s, f)
    cases = {
        "C=0": lambda: SetConfig(C=0.0), "C=-1": lambda: SetConfig(C=-1.0), "reg=l1": lambda: SetConfig(reg="l1"), "estimator=svm": lambda: SetConfig(estimator="svm"), "epsilon_mode=other": lambda: SetConfig(epsilon_mode="other"), "reg=L2": lambda: SetConfig(reg="L2"),
        "theta too long": lambda: oracle.objective(p, [1.0, 2.0, 3.0]), "batch too wide": lambda: oracle.contains_many(p, [[1.0, 2.0, 3.0]]), "interval too long": lambda: certify.interval(p, [1.0]), "index out of range": lambda: certify.coef_intervals(p, [2]), "bands of a linear set": lambda: certify.bands(lin, C.part(s, f)),
        "sampler=other": lambda: draw.sample(p, 3, "other"), "no samples": lambda: draw.ellipsoid(p, 0), "perm_mode=other": lambda: importance.reliance(p, docs, C.BATCH, perm_mode="other"), "threshold of a linear set": lambda: multiplicity.threshold(lin), "threshold mode=other": lambda: multiplicity.threshold(p, docs, "other"), "threshold value=1": lambda: multiplicity.threshold(p, value=1.0),
        "threshold without rows": lambda: multiplicity.threshold(p, None, "youden"), "metric=other": lambda: multiplicity.multiplicity(p, docs, ("other",)), "importance mode=other": lambda: _api(lin).variable_importance("other"), "missing column": lambda: FeatureSpec(("x9",)).project(docs), "text column": lambda: FeatureSpec(("lang",)).project(docs), "names too few": lambda: importance.cloud_of(p, oracle.samples_frame(s, C.BATCH), ["a"]),
        **{f"{k}={v}": (lambda k=k, v=v: draw.hit_and_run(p, **{k: v})) for k, v in (("n_samples", 0), ("chains", 0), ("burnin", -1), ("thin", 0), ("t_init", 0.0), ("growth", 1.0), ("max_bracket", 0.0), ("max_bisect", 0), ("tol", 0.0), ("directions", "other"))},
    }
    return s.createDataFrame([(name, _raised(call)) for name, call in cases.items()], "name string, outcome string")


_CASES = {
    "C=0": "ValueError", "C=-1": "ValueError", "reg=l1": "ValueError", "estimator=svm": "ValueError", "epsilon_mode=other": "ValueError", "reg=L2": "accepted", "theta too long": "ValueError", "batch too wide": "ValueError", "interval too long": "ValueError", "index out of range": "ValueError",
    "bands of a linear set": "NotImplementedError", "sampler=other": "ValueError", "no samples": "ValueError", "perm_mode=other": "ValueError", "threshold of a linear set": "ValueError", "threshold mode=other": "ValueError", "threshold value=1": "ValueError", "threshold without rows": "ValueError", "metric=other": "ValueError",
    "importance mode=other": "NotImplementedError", "missing column": "ValueError", "text column": "ValueError", "names too few": "ValueError", "n_samples=0": "ValueError", "chains=0": "ValueError", "burnin=-1": "ValueError", "thin=0": "ValueError", "t_init=0.0": "ValueError", "growth=1.0": "ValueError",
    "max_bracket=0.0": "ValueError", "max_bisect=0": "ValueError", "tol=0.0": "ValueError", "directions=other": "ValueError",
}


# ------------------------------------------------------------------------------------------------- single calls
def _api(fitted: fitting.FittedSet) -> NearOptimalSet:
    out = NearOptimalSet(**fitted.config.as_dict())
    out.fitted = fitted
    return out


def _margins(s, f) -> DataFrame:
    """(sample_id, margin, y) of the batch: scores that are known already."""
    batch = oracle.samples_frame(s, C.BATCH).select("sample_id", F.element_at("theta", 1).alias("a0"), F.element_at("theta", 2).alias("a1"))
    return C.documents(s, f).crossJoin(F.broadcast(batch)).select("sample_id", (F.col("a0") * F.col("x0") + F.col("a1") * F.col("x1")).alias("margin"), "y")


def _one(s, f) -> DataFrame:
    p, theta = _api(C.document_set(s, f)), C.BATCH[1]
    known = _margins(s, f).where("sample_id = 1").select("margin", "y")
    return C.one_row(s, objective=p.objective(theta), objective_known=p.objective(theta, margins=known), gap=p.loss_gap(theta), gap_known=p.loss_gap(theta, margins=known), inside=bool(p.contains(theta)), inside_known=bool(p.contains(theta, margins=known)), wide=bool(p.contains(theta, atol=10.0)))


def _known_many(s, f) -> DataFrame:
    p, known = _api(C.document_set(s, f)), _margins(s, f).persist()
    values = zip(p.objective_many(C.BATCH, margins=known), p.loss_gap_many(C.BATCH, margins=known), p.contains_many(C.BATCH, margins=known))
    out = C.rounded(s.createDataFrame([(i, float(o), float(g), bool(c)) for i, (o, g, c) in enumerate(values)], "sample_id int, objective double, loss_gap double, inside boolean"))
    known.unpersist()
    return out


def _surface(s, f) -> DataFrame:
    p = NearOptimalSet(estimator="linear", epsilon=C.RHO).set_params(C=0.5, random_state=3).fit(C.part(s, f), C.PART.columns, "y", "p_partkey")
    rows = [(k, str(v)) for k, v in p.get_params().items()] + [("n_features_in_", str(p.n_features_in_)), ("coef_", str(p.coef_.shape))]
    return s.createDataFrame(rows, "name string, value string")


_PARAMS = {"estimator": "linear", "reg": "l2", "C": "0.5", "epsilon": "0.05", "epsilon_mode": "percent_loss", "sampler": "ellipsoid", "measure": "lr", "random_state": "3", "max_iter": "1000", "tol": "1e-06", "safety_override": "False", "bootstrap_fallback": "True", "bootstrap_reps": "200", "fit_scale": "sum", "n_features_in_": "2", "coef_": "(2,)"}


def _defaults(s, f) -> DataFrame:
    return s.createDataFrame([(k, str(v)) for k, v in NearOptimalSet().get_params().items()], "name string, value string")


_DEFAULTS = _PARAMS | {"estimator": "logistic", "C": "1.0", "epsilon": "0.02", "random_state": "None"}
_DEFAULTS = {k: v for k, v in _DEFAULTS.items() if not k.endswith("_")}


def _pairs(values: dict[str, str], second: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in values.items()) + f") t(name, {second})"


def _free_products(s, f) -> DataFrame:
    docs, c = C.documents(s, f), SetConfig()
    frame = C.DOCS.project(docs, False)
    hv = matrixfree.hessian_products(frame, "logistic", C.THETA, c.lam, V)
    m = matrixfree.preconditioner(frame, "logistic", C.THETA, c.lam)
    x = {p: matrixfree.solve(docs, C.DOCS, c, C.THETA, V, p, 1e-10) for p in (True, False)}
    return C.one_row(s, hv0=float(hv[0]), hv1=float(hv[1]), m0=float(m[0]), m1=float(m[1]), x0=float(x[True][0]), x1=float(x[True][1]), plain0=float(x[False][0]), plain1=float(x[False][1]), norm=matrixfree.inverse_norm(docs, C.DOCS, c, C.THETA, V, tol=1e-10))


def _distance(s, f) -> DataFrame:
    a, b = C.part_set(s, f), fitting.fit(C.part(s, f), C.PART, SetConfig(estimator="linear", C=0.01))
    return C.one_row(s, distance=multiplicity.coefficient_distance(a, b))


def _set_row(s, f) -> DataFrame:
    return C.rounded(certify.diagnostics(C.part_set(s, f)).select("estimator", "n", "d", F.col("lambda").alias("lam"), "l_hat", "theta_norm", "epsilon", "epsilon_mode", "calibration", "implied_alpha", "measure", "kappa", "least_weight", "least_margin", "set_fidelity", "isotropy_ratio"))


def _fitted_row(s, f) -> DataFrame:
    return C.rounded(certify.diagnostics(C._flagship_set(s, f)).select("n", "l_hat", "theta_norm", "epsilon", "kappa", "least_weight", "least_margin"))


# ------------------------------------------------------------------------------------------------- samplers
def _even_draws(s, f) -> DataFrame:
    batch = _api(C.part_set(s, f)).sample(50, sampler="Ellipsoid", numbers="even")
    return C.rounded(oracle.samples_frame(s, batch).select("sample_id", F.element_at("theta", 1).alias("a0"), F.element_at("theta", 2).alias("a1")))


def _even_walk(s, f) -> DataFrame:
    rows = _api(C.part_set(s, f)).sample_hitandrun(WALKED, chains=CHAINS, burnin=BURNIN, numbers="even", compute_diagnostics=False)
    return C.rounded(rows.select("chain_id", "step", F.element_at("theta", 1).alias("a0"), F.element_at("theta", 2).alias("a1")))


def _walk_members(s, f) -> DataFrame:
    """Of both model families and kinds of directions: draws, those inside the set, and chains; with diagnostics kept."""
    rows = []
    for name, fitted in (("linear", C.part_set(s, f)), ("logistic", C.document_set(s, f))):
        for how in ("whitened", "euclidean"):
            p = _api(fitted)
            taken = p.sample_hitandrun(20, chains=2, burnin=5, thin=2, directions=how, random_state=7).collect()
            inside = int(p.contains_many([r.theta for r in taken], 1e-9).sum())
            rows.append((name, how, len(taken), inside, len({r.chain_id for r in taken}), p.diagnostics().first().set_fidelity))
    return s.createDataFrame(rows, "family string, directions string, n long, inside long, chains long, fidelity double")


def _burned(s, f) -> DataFrame:
    """Diagnostics after a burn-in, and of few draws."""
    p = C.document_set(s, f)
    batch = C.draws(p)
    keep = ("n_samples", "chord_mean", "isotropy_ratio")
    whole = diagnose.sample_diagnostics(p, batch, burnin=20).select(F.lit("burned").alias("name"), *keep, F.element_at("ess_per_param", 1).alias("ess0"))
    few = diagnose.sample_diagnostics(p, batch[:6]).select(F.lit("few").alias("name"), *keep, F.element_at("ess_per_param", 1).alias("ess0"))
    plain = diagnose.sample_diagnostics(p, batch[:30], compute_ess=False, compute_isotropy=False).select(F.lit("plain").alias("name"), *keep, F.element_at("ess_per_param", 1).alias("ess0"))
    none = diagnose.sample_diagnostics(p, batch[:1]).select(F.lit("none").alias("name"), *keep, F.element_at("ess_per_param", 1).alias("ess0"))
    return C.rounded(whole.unionByName(few).unionByName(plain).unionByName(none))


def _burned_sql() -> str:
    eig = "sqrt((v0 - v1) * (v0 - v1) / 4 + c * c)"
    part = lambda name, where, ess, iso: f"SELECT '{name}' AS name, CAST(count(*) AS INTEGER) AS n_samples, round(avg(CASE WHEN b0 IS NOT NULL THEN sqrt((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1)) END), 6) + 0.0e0 AS chord_mean, {iso} AS isotropy_ratio, {ess} AS ess0 FROM (SELECT *, lag(a0) OVER (ORDER BY sample_id) AS b0, lag(a1) OVER (ORDER BY sample_id) AS b1 FROM drawn WHERE {where})"
    iso = "(SELECT round(((v0 + v1) / 2 + " + eig + ") / ((v0 + v1) / 2 - " + eig + "), 6) + 0.0e0 FROM (SELECT var_samp(a0) AS v0, var_samp(a1) AS v1, covar_samp(a0, a1) AS c FROM drawn WHERE {}))"
    ess = "round(greatest(1.0e0, count(*) * (1 - greatest(-0.99e0, least(0.99e0, corr(a0, b0)))) / (1 + greatest(-0.99e0, least(0.99e0, corr(a0, b0))))), 6) + 0.0e0"
    null = "CAST(NULL AS DOUBLE)"
    return f"WITH {C.DOC_DRAWS} " + " UNION ALL ".join([part("burned", "sample_id >= 20", ess, iso.format("sample_id >= 20")), part("few", "sample_id < 6", null, iso.format("sample_id < 6")), part("plain", "sample_id < 30", null, null), f"SELECT 'none', 1, {null}, {null}, {null}"])


def _vic(s, f) -> DataFrame:
    return C.rounded(_api(C.part_set(s, f)).variable_importance("VIC", n_samples=50, numbers="even"))


# ------------------------------------------------------------------------------------------------- importance, multiplicity
def _accuracy(s, f) -> DataFrame:
    return C.rounded(importance.reliance(C.document_set(s, f), C.documents(s, f), C.BATCH, C.REPS, order=C.even_order("doc_id")))


def _accuracy_sql() -> str:
    order = lambda m: f"(CAST(key AS DOUBLE) * ({m})) * {C.STEPS[0]}e0 - floor((CAST(key AS DOUBLE) * ({m})) * {C.STEPS[0]}e0)"
    return f"""WITH {C.Z}, batch(sample_id, a0, a1) AS (VALUES {C._values(C.BATCH)}),
wide AS (SELECT doc_id AS key, y, j, rep, CASE j WHEN 0 THEN x0 ELSE x1 END AS own, CASE j WHEN 0 THEN x1 ELSE x0 END AS other FROM z, (SELECT CAST(range AS INTEGER) AS j FROM range(0, 2)), (SELECT CAST(range AS INTEGER) AS rep FROM range(0, {C.REPS}))),
placed AS (SELECT *, row_number() OVER (PARTITION BY j, rep ORDER BY {order('-9.0e0')}, key) AS here, row_number() OVER (PARTITION BY j, rep ORDER BY {order('1.0e0 + 3.0e0 * j + 7.0e0 * rep')}, key) AS there FROM wide),
met AS (SELECT p.j, p.y, p.other, q.own AS xp FROM placed p JOIN placed q ON p.j = q.j AND p.rep = q.rep AND p.here = q.there),
hit AS (SELECT sample_id, j, avg(CASE WHEN (CASE j WHEN 0 THEN a1 ELSE a0 END * other + CASE j WHEN 0 THEN a0 ELSE a1 END * xp > 0) = (y > 0.5) THEN 1.0e0 ELSE 0.0e0 END) AS permuted FROM met, batch GROUP BY sample_id, j),
base AS (SELECT sample_id, avg(CASE WHEN (a0 * x0 + a1 * x1 > 0) = (y > 0.5) THEN 1.0e0 ELSE 0.0e0 END) AS base FROM z, batch GROUP BY sample_id)
SELECT sample_id, j, {C._r('base')}, {C._r('permuted')}, round(base - permuted, 6) + 0.0e0 AS importance FROM hit JOIN base USING (sample_id)"""


_TAUS = f"""{C.SET}, q AS (SELECT i, quantile FROM (SELECT unnest(range(0, 99)) AS i, unnest(quantile_cont(margin, [{", ".join(f"{i / 100}" for i in range(1, 100))}])) AS quantile FROM s)),
yo AS (SELECT i, quantile, avg(CASE WHEN y = 1 THEN CASE WHEN margin >= quantile THEN 1.0e0 ELSE 0.0e0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN margin < quantile THEN 1.0e0 ELSE 0.0e0 END END) - 1 AS j FROM s, q GROUP BY i, quantile),
neg AS (SELECT margin, row_number() OVER (ORDER BY margin) - 1 AS i, count(*) OVER () AS m FROM s WHERE y = 0),
taus AS (SELECT 'fixed' AS mode, 0.0e0 AS tau UNION ALL SELECT 'match_prevalence', ln(avg(y) / (1 - avg(y))) FROM s UNION ALL SELECT 'match_fpr', margin FROM neg WHERE i = least(greatest(CAST(floor(0.95e0 * m) AS BIGINT), 0), m - 1) UNION ALL SELECT 'youden', quantile FROM (SELECT quantile FROM yo ORDER BY j DESC, i LIMIT 1))"""


def _single(s, f) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return C.rounded(multiplicity.discrepancy(C.document_set(s, f), C.documents(s, f), C.BATCH[:1]))


def _metrics(s, f) -> DataFrame:
    out = multiplicity.multiplicity(C.document_set(s, f), C.documents(s, f), ("ambiguity", "discrepancy", "capacity"), C.BATCH, threshold_mode="match_prevalence", n_pairs=1, random_state=0)
    return C.rounded(out["ambiguity"].crossJoin(out["discrepancy"].select("discrepancy_bound")).crossJoin(out["capacity"]))  # a row each


def _stream(s, f) -> DataFrame:
    """Bands of the documents as a stream of files, written once by its checkpoint and read back."""
    rows = C.documents(s, f)
    source, sink, checkpoint = (new_path(s, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    rows.write.parquet(source)
    query = scoring.start(C.document_set(s, f), s.readStream.schema(rows.schema).parquet(source), sink, checkpoint)
    query.awaitTermination()
    return C.rounded(s.read.parquet(sink).withColumnRenamed("key", "doc_id"))


QUERIES: dict[str, tuple[Callable, str | None]] = {
    # fits and calibration
    "certified_documents": (C.flagship, f"WITH RECURSIVE {_fitted(100.0, C.RHO)} SELECT {_BANDS}"),
    "fitted_documents": (_fitted_row, f"WITH RECURSIVE {_fitted(100.0, C.RHO)} SELECT n, {C._r('l_hat')}, {C._r('theta_norm', 'sqrt(t0 * t0 + t1 * t1)')}, {C._r('epsilon', 'eps')}, {C._r('kappa', _KAPPA)}, {C._r('least_weight')}, {C._r('least_margin')} FROM h"),
    "logistic_fit_mean_scale": (_mean_scale, f"WITH RECURSIVE {_newton('0.01e0 * count(*)')} SELECT {C._r('theta0', 't0')}, {C._r('theta1', 't1')} FROM th"),
    "wilks_epsilon": (_wilks, f"WITH {C.SET} SELECT round({-math.log(0.05)!r}e0, 6) AS epsilon, 0.05e0 AS alpha, 'wilks' AS calibration FROM h"),
    "epsilon_modes": (_modes, "SELECT * FROM (VALUES ('percent', 0.02e0, 'percent_loss', CAST(NULL AS DOUBLE)), ('clipped', 1.0e0, 'percent_loss', NULL), ('linear', 0.05e0, 'fallback', NULL), ('highdim', 0.05e0, 'fallback', NULL), ('without', 0.05e0, 'fallback', NULL)) t(mode, share, calibration, alpha)"),
    "bootstrap_even": (_bootstrap, _replicates()),
    "argument_checks": (_cases, _pairs(_CASES, "outcome")),
    # linear operators and membership
    "matrix_free": (_free_products, f"WITH {C.SET} SELECT {C._r('hv0', f'h00 * {V[0]}e0 + h01 * ({V[1]}e0)')}, {C._r('hv1', f'h01 * {V[0]}e0 + h11 * ({V[1]}e0)')}, {C._r('m0', '1 / (h00 + 1e-12)')}, {C._r('m1', '1 / (h11 + 1e-12)')}, " + ", ".join(C._r(f"{name}{i}", e) for name in ("x", "plain") for i, e in enumerate((f"(h11 * {V[0]}e0 - h01 * ({V[1]}e0)) / det", f"(h00 * ({V[1]}e0) - h01 * {V[0]}e0) / det"))) + f", {C._r('norm', f'sqrt(({V[0] ** 2}e0 * h11 - 2 * ({V[0] * V[1]}e0) * h01 + {V[1] ** 2}e0 * h00) / det)')} FROM h"),
    "membership_of_one": (_one, f"WITH {C.OBJECTIVES} SELECT {C._r('objective')}, {C._r('objective_known', 'objective')}, {C._r('gap', 'loss_gap')}, {C._r('gap_known', 'loss_gap')}, inside, inside AS inside_known, true AS wide FROM gaps WHERE sample_id = 1"),
    "known_scores": (_known_many, f"WITH {C.OBJECTIVES} SELECT sample_id, {C._r('objective')}, {C._r('loss_gap')}, inside FROM gaps"),
    # the estimator's surface
    "estimator_params": (_surface, _pairs(_PARAMS, "value")),
    "estimator_defaults": (_defaults, _pairs(_DEFAULTS, "value")),
    "set_diagnostics": (_set_row, f"WITH {C.PSET} SELECT 'linear' AS estimator, n, 2 AS d, 1.0e0 AS lam, {C._r('l_hat')}, {C._r('theta_norm', 'sqrt(t0 * t0 + t1 * t1)')}, {C._r('epsilon', 'eps')}, 'percent_loss' AS epsilon_mode, 'percent_loss' AS calibration, CAST(NULL AS DOUBLE) AS implied_alpha, 'lr' AS measure, {C._r('kappa', _KAPPA)}, 1.0e0 AS least_weight, CAST(NULL AS DOUBLE) AS least_margin, CAST(NULL AS DOUBLE) AS set_fidelity, CAST(NULL AS DOUBLE) AS isotropy_ratio FROM h"),
    "coefficient_distance": (_distance, f"WITH {C.PSET}, o AS (SELECT t0, t1, ((g11 + 100) * c0 - g01 * c1) / ((g00 + 100) * (g11 + 100) - g01 * g01) AS o0, ((g00 + 100) * c1 - g01 * c0) / ((g00 + 100) * (g11 + 100) - g01 * g01) AS o1 FROM h) SELECT {C._r('distance', 'sqrt((t0 - o0) * (t0 - o0) + (t1 - o1) * (t1 - o1))')} FROM o"),
    # samplers and their diagnostics
    "ellipsoid_even": (_even_draws, f"WITH {_PART_CENTRE}, {_ball(50)} SELECT sample_id, {C._r('a0')}, {C._r('a1')} FROM drawn"),
    "hit_and_run_even": (_even_walk, _walk()),
    "hit_and_run_members": (_walk_members, "SELECT *, CAST(20 AS BIGINT) AS n, CAST(20 AS BIGINT) AS inside, CAST(2 AS BIGINT) AS chains, 1.0e0 AS fidelity FROM (VALUES ('linear', 'whitened'), ('linear', 'euclidean'), ('logistic', 'whitened'), ('logistic', 'euclidean')) t(family, directions)"),
    "diagnostics_after_burnin": (_burned, _burned_sql()),
    "vic_of_sampler": (_vic, f"WITH {_PART_CENTRE}, {_ball(50)}, v AS (SELECT 0 AS j, 'x0' AS feature, t0 AS t, a0 AS v FROM drawn, t UNION ALL SELECT 1, 'x1', t1, a1 FROM drawn, t) SELECT j, feature, {C._r('theta_hat', 'any_value(t)')}, {C._r('mean', 'avg(v)')}, {C._r('std', 'stddev_pop(v)')}, " + ", ".join(C._r(f"q{int(100 * q):02d}", f"quantile_cont(v, {q})") for q in importance.QUANTILES) + " FROM v GROUP BY j, feature"),
    # importance, thresholds and multiplicity
    "mcr_accuracy": (_accuracy, _accuracy_sql()),
    "threshold_fixed": (lambda s, f: C.one_row(s, half=multiplicity.threshold(C.document_set(s, f)), most=multiplicity.threshold(C.document_set(s, f), value=0.7)), f"SELECT 0.0e0 AS half, round({math.log(0.7 / 0.3)!r}e0, 6) AS most"),
    "threshold_sweep": (lambda s, f: C.rounded(multiplicity.threshold_sweep(C.document_set(s, f), C.documents(s, f))), f"WITH {_TAUS} SELECT mode, {C._r('tau')}, round(avg(CASE WHEN lo <= tau AND hi >= tau THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS ambiguity_rate FROM s, taus GROUP BY mode, tau"),
    "discrepancy_of_one": (_single, f"WITH {C.SET} SELECT round(avg(CAST(ambiguous AS DOUBLE)), 6) + 0.0e0 AS discrepancy_bound, CAST(NULL AS DOUBLE) AS discrepancy_empirical, CAST(NULL AS DOUBLE) AS max_pair_disagreement, CAST(NULL AS DOUBLE) AS mean_pair_disagreement, 0.0e0 AS threshold FROM s"),
    "multiplicity_metrics": (_metrics, f"WITH {_TAUS} SELECT round(avg(CASE WHEN lo <= tau AND hi >= tau THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS ambiguity_rate, CAST(sum(CASE WHEN lo <= tau AND hi >= tau THEN 1 ELSE 0 END) AS BIGINT) AS n_ambiguous, round(any_value(tau), 6) + 0.0e0 AS threshold, round(avg(CASE WHEN lo <= tau AND hi >= tau THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS discrepancy_bound, (SELECT round(ln(pi()) - 0.5e0 * ln(det) + ln(2 * eps), 6) + 0.0e0 FROM h) AS log_volume, 2.0e0 AS effective_dim, (SELECT round(ln(det), 6) + 0.0e0 FROM h) AS log_det_hessian FROM s, (SELECT tau FROM taus WHERE mode = 'match_prevalence')"),
    "bands_stream": (_stream, f"WITH {C.SET} SELECT {_BANDS}"),
}
