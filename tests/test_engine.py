"""The engine against NumPy, published numbers, and relations that must hold."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearopt.api import NearOptimalSet
from nearopt.config import FeatureSpec, SetConfig
from nearopt.functions import features
from nearopt.functions import order
from nearopt.operators import calibrate, certify, importance, linalg, matrixfree, multiplicity, oracle
from nearopt.operators import fit as fitting
from nearopt.operators import sample as draw
from nearopt.operators import stats
from nearopt.sources import tables
from nearopt.streaming import scoring


def names(d):
    return tuple(f"x{j}" for j in range(d))


def frame(spark, x, y):
    return tables.from_arrays(spark, x, y).persist()


def data(kind="logistic", n=80, d=3, seed=0, corr=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 1:] = x[:, 1:] * math.sqrt(1 - corr**2) + corr * x[:, :1]
    w = np.linspace(1.2, -0.8, d)
    y = (rng.random(n) < 1 / (1 + np.exp(-x @ w))).astype(float) if kind == "logistic" else x @ w + 0.3 * rng.normal(size=n)
    return x, y


def fitted(spark, kind="logistic", corr=0.0, n=80, d=3, **params):
    x, y = data(kind, n, d, corr=corr)
    s = NearOptimalSet(estimator=kind, random_state=1, **{"epsilon": 0.1} | params)
    df = frame(spark, x, y)
    return s.fit(df, names(d), "y", "row_id"), df, x, y


def objective(kind, x, y, theta, lam):
    m = x @ theta
    loss = np.logaddexp(0, m) - y * m if kind == "logistic" else 0.5 * (y - m) ** 2
    return loss.mean() + lam / 2 * theta @ theta


@pytest.mark.parametrize("kind", ["logistic", "linear"])
@pytest.mark.parametrize("scale", ["sum", "mean"])
def test_fit_minimises_its_objective(spark, kind, scale):
    s, df, x, y = fitted(spark, kind, fit_scale=scale, C=0.5)
    n, lam = len(y), 2.0
    effective = lam / n if scale == "sum" else lam
    m = x @ s.coef_
    residual = (1 / (1 + np.exp(-m)) if kind == "logistic" else m) - y
    assert np.abs(x.T @ residual / n + effective * s.coef_).max() < 1e-8
    assert s.fitted.l_hat == pytest.approx(objective(kind, x, y, s.coef_, lam), abs=1e-10)
    w = 1 / (1 + np.exp(-m)) * (1 - 1 / (1 + np.exp(-m))) if kind == "logistic" else np.ones(n)
    h = (x.T * w) @ x / n + lam * np.eye(3)
    assert np.allclose(s.fitted.hessian, h) and s.fitted.kappa == pytest.approx(np.linalg.cond(h))
    assert s.fitted.epsilon == pytest.approx(0.1 * s.fitted.l_hat)


def test_published_numbers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 6))
    w = rng.normal(size=6)
    y = (rng.random(64) < 1 / (1 + np.exp(-(x @ w)))).astype(float)
    logistic = NearOptimalSet().fit(frame(spark, x, y), names(6), "y")
    # The published results of this recipe.
    assert logistic.fitted.l_hat == pytest.approx(2.30844902, rel=1e-3)
    assert np.linalg.norm(logistic.coef_) == pytest.approx(1.94736079, rel=1e-3)
    assert logistic.fitted.epsilon == pytest.approx(0.04616898, rel=1e-3)
    x = rng.normal(size=(64, 6))
    w = rng.normal(size=6)
    y = x @ w + 0.1 * rng.normal(size=64)
    df = frame(spark, x, y)
    linear = NearOptimalSet(estimator="linear").fit(df, names(6), "y")
    assert linear.fitted.l_hat == pytest.approx(1.00825272, abs=1e-8)
    assert linear.fitted.kappa == pytest.approx(1.67812535, abs=1e-8)
    assert linear.score(df) == pytest.approx(0.99639310, abs=1e-8)
    got = linear.hacking_interval(rng.normal(size=6))
    assert (got["min"], got["max"]) == (pytest.approx(-1.44536705, abs=1e-8), pytest.approx(-0.79751339, abs=1e-8))


@pytest.mark.parametrize("kind", ["logistic", "linear"])
def test_membership(spark, kind):
    s, df, x, y = fitted(spark, kind)
    batch = np.vstack([s.coef_, s.coef_ + 0.05, s.coef_ + 10, np.zeros(3)])
    want = [objective(kind, x, y, t, 1.0) for t in batch]
    assert np.allclose(s.objective_many(batch), want) and s.objective(batch[1]) == pytest.approx(want[1])
    assert np.allclose(s.loss_gap_many(batch), np.array(want) - s.fitted.l_hat)
    assert s.contains(s.coef_) and not s.contains(batch[2])
    assert s.contains_many(batch).tolist() == [g <= s.fitted.epsilon for g in s.loss_gap_many(batch)]
    scores = df.sparkSession.createDataFrame([(k, float(m), float(t)) for k, b in enumerate(batch) for m, t in zip(x @ b, y)], "sample_id int, margin double, y double")
    assert np.allclose(s.objective_many(batch, margins=scores), want)
    assert s.objective(batch[1], margins=scores.where("sample_id = 1")) == pytest.approx(want[1])
    inside = [r.sample_id for r in oracle.members(s.fitted, batch).collect()]
    assert sorted(inside) == np.flatnonzero(s.contains_many(batch)).tolist()
    with pytest.raises(ValueError):
        s.objective(np.zeros(2))
    with pytest.raises(ValueError):
        s.objective_many(np.zeros((2, 4)))


def test_certificates(spark):
    s, df, x, y = fitted(spark)
    hinv = np.linalg.inv(s.fitted.hessian)
    half = math.sqrt(2 * s.fitted.epsilon) * np.sqrt(np.einsum("ij,jk,ik->i", x, hinv, x))
    rows = s.probability_bands(df).orderBy("key").collect()
    m = x @ s.coef_
    assert np.allclose([r.lo for r in rows], m - half) and np.allclose([r.hi for r in rows], m + half)
    assert all(r.p_lo <= r.p <= r.p_hi for r in rows)
    ci = s.coef_intervals().orderBy("j").collect()
    assert np.allclose([r.hi - r.lo for r in ci], 2 * math.sqrt(2 * s.fitted.epsilon) * np.sqrt(np.diag(hinv)))
    assert [r.j for r in s.coef_intervals([2]).collect()] == [2]
    with pytest.raises(ValueError):
        s.coef_intervals([3])
    assert [r.prediction for r in s.predict(df).orderBy("key").collect()] == (m > 0).astype(float).tolist()
    assert s.score(df) == pytest.approx(np.mean((m > 0) == y))
    proba = s.predict_proba(df).orderBy("key").collect()
    assert np.allclose([r.p0 + r.p1 for r in proba], 1)
    linear, ldf, *_ = fitted(spark, "linear")
    with pytest.raises(NotImplementedError):
        linear.probability_bands(ldf)
    row = s.diagnostics().first()
    assert row.n == 80 and row.d == 3 and row["lambda"] == 1.0 and row.seed == 1


@pytest.mark.parametrize("corr", [0.0, 0.95])
def test_ellipsoid_draws_are_uniform(spark, corr):
    s, *_ = fitted(spark, corr=corr)
    draws = s.sample_ellipsoid(4000, 3) - s.coef_
    q = np.einsum("ij,jk,ik->i", draws, s.fitted.hessian, draws) / (2 * s.fitted.epsilon)
    assert q.max() <= 1 + 1e-9
    radius = np.sort(q ** (3 / 2))  # of uniform draws, uniform
    assert np.abs(radius - (np.arange(4000) + 0.5) / 4000).max() < 0.03
    second = draws.T @ draws / len(draws)
    assert np.allclose(second, 2 * s.fitted.epsilon / 5 * np.linalg.inv(s.fitted.hessian), rtol=0.25, atol=0.02 * np.abs(second).max())
    assert (s.sample_ellipsoid(5, 3) == s.sample_ellipsoid(5, 3)).all()


@pytest.mark.parametrize("kind", ["logistic", "linear"])
@pytest.mark.parametrize("directions", ["whitened", "euclidean"])
def test_hit_and_run_stays_inside(spark, kind, directions):
    s, *_ = fitted(spark, kind, fit_scale="mean")
    rows = s.sample_hitandrun(40, chains=2, burnin=10, directions=directions, random_state=2)
    batch = np.array([r.theta for r in rows.orderBy("chain_id", "step").collect()])
    assert batch.shape == (40, 3) and s.contains_many(batch, 1e-9).all() and batch.std(0).min() > 0
    d = s.diagnostics().first()
    assert d.set_fidelity == 1.0 and d.isotropy_ratio >= 1
    with pytest.raises(ValueError):
        s.sample_hitandrun(0)
    with pytest.raises(ValueError):
        s.sample(5, sampler="other")


@pytest.mark.parametrize("directions", ["whitened", "euclidean"])
def test_chains_over_many_rows_draw_the_same(spark, monkeypatch, directions):
    s, *_ = fitted(spark, fit_scale="mean")
    how = {"chains": 2, "burnin": 1, "random_state": 1, "directions": directions, "t_init": 0.1, "growth": 1.7, "max_bracket": 1e3, "max_bisect": 30, "tol": 1e-9}
    held = sorted(tuple(r) for r in draw.hit_and_run(s.fitted, 3, **how).collect())
    monkeypatch.setattr(draw, "HELD", 0)
    passes = sorted(tuple(r) for r in draw.hit_and_run(s.fitted, 3, **how).collect())
    assert [r[:2] for r in held] == [r[:2] for r in passes] == [(0, 0), (0, 1), (1, 0)]
    assert np.allclose([r[2] for r in held], [r[2] for r in passes], atol=1e-6)
    assert s.contains_many([r[2] for r in passes], 1e-9).all()
    with pytest.raises(RuntimeError):  # every chord is rejected, by rows held or not
        draw.hit_and_run(s.fitted, 1, chains=1, burnin=0, t_init=1e-9, growth=1.5, max_bracket=1e-8, random_state=1)


def test_directions_by_conjugate_gradients(spark):
    s, df, x, y = fitted(spark, "linear", fit_scale="mean")
    rows = {p: np.array([r.theta for r in draw.hit_and_run(s.fitted, 12, chains=2, burnin=2, random_state=4, precondition=p).orderBy("chain_id", "step").collect()]) for p in (None, True, False)}
    assert np.allclose(rows[None], rows[True], atol=1e-6) and np.allclose(rows[None], rows[False], atol=1e-6)
    b = np.array([1.0, -2.0, 0.5])
    for kind in ("linear", "logistic"):
        s, df, x, y = fitted(spark, kind)
        f, c = s.fitted, s.config
        assert np.allclose(matrixfree.hessian_products(f.frame, kind, f.theta, f.lam, np.stack([b, -b])), np.stack([f.hessian @ b, -f.hessian @ b]))
        assert np.allclose(matrixfree.preconditioner(f.frame, kind, f.theta, f.lam), 1 / (np.diag(f.hessian) + 1e-12))
        for precondition in (True, False):
            assert np.allclose(matrixfree.solve(df, f.spec, c, f.theta, b, precondition, 1e-10), np.linalg.solve(f.hessian, b), atol=1e-8)
        assert matrixfree.inverse_norm(df, f.spec, c, f.theta, b, tol=1e-10) == pytest.approx(np.linalg.norm(f.inverse_factor @ b))


def test_sample_diagnostics(spark):
    s, *_ = fitted(spark)
    batch = s.sample(50)
    row = s.compute_sample_diagnostics(batch).first()
    steps = np.linalg.norm(np.diff(batch, axis=0), axis=1)
    assert (row.chord_mean, row.chord_std, row.chord_min, row.chord_max) == tuple(pytest.approx(f(steps)) for f in (np.mean, np.std, np.min, np.max))
    assert row.isotropy_ratio == pytest.approx(np.linalg.cond(np.cov(batch, rowvar=False)))
    for j, ess in enumerate(row.ess_per_param):
        r = np.clip(np.corrcoef(batch[:-1, j], batch[1:, j])[0, 1], -0.99, 0.99)
        assert ess == pytest.approx(max(1, 50 * (1 - r) / (1 + r)))
    short = s.compute_sample_diagnostics(batch[:5]).first()
    assert short.n_samples == 5 and short.ess_per_param is None and short.chord_mean is not None
    assert s.compute_sample_diagnostics(batch[:1]).first().set_fidelity is None
    assert s.compute_sample_diagnostics(batch, burnin=10).first().n_samples == 40


def test_cloud_is_that_of_the_draws(spark):
    s, *_ = fitted(spark)
    rows = s.variable_importance_cloud(n_samples=70, random_state=4, feature_names=["a", "b", "c"]).orderBy("j").collect()
    batch = s.sample(70, random_state=4)
    for j, r in enumerate(rows):
        assert r.feature == "abc"[j] and r.mean == pytest.approx(batch[:, j].mean()) and r.std == pytest.approx(batch[:, j].std())
        assert [r.q05, r.q25, r.q50, r.q75, r.q95] == pytest.approx(np.quantile(batch[:, j], importance.QUANTILES).tolist())
    with pytest.raises(NotImplementedError):
        s.variable_importance("other")


@pytest.mark.parametrize("mode", importance.MODES)
@pytest.mark.parametrize("kind", ["logistic", "linear"])
def test_reliance_against_permuted_copies(spark, kind, mode):
    s, df, x, y = fitted(spark, kind, n=60)
    batch = s.sample(4, random_state=1)
    got = {(r.sample_id, r.j): r for r in s.model_class_reliance_matrix(df, batch=batch, n_permutations=3, perm_mode=mode).collect()}
    frame_ = s.fitted.spec.project(df, True)
    moved = importance.permuted(frame_, 3, mode, 3, seed=1).collect()
    score = lambda m, t: np.mean((m > 0) == (t > 0.5)) if kind == "logistic" else 1 - ((t - m) ** 2).sum() / ((t - y.mean()) ** 2).sum()
    for k, theta in enumerate(batch):
        assert got[k, 0].base == pytest.approx(score(x @ theta, y))
        for j in range(3):
            rows = [r for r in moved if r.j == j]
            xs, ts, xp = np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.xp for r in rows])
            assert sorted(xp) == pytest.approx(sorted(np.tile(x[:, j], 3)))  # a permutation
            if mode != "residual":
                xs[:, j] = xp
                m = xs @ theta
                want = np.mean((m > 0) == (ts > 0.5)) if kind == "logistic" else 1 - ((ts - m) ** 2).sum() / (3 * ((y - y.mean()) ** 2).sum())
                assert got[k, j].permuted == pytest.approx(want)
            assert got[k, j].importance == pytest.approx(got[k, j].base - got[k, j].permuted)


def test_informative_features_lead(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    df = frame(spark, x, 3 * x[:, 0] + 0.1 * rng.normal(size=80))
    s = NearOptimalSet(estimator="linear", random_state=0).fit(df, names(6), "y", "row_id")
    summary = s.model_class_reliance(df, n_samples=10, n_permutations=4)
    assert importance.top_features(summary, "importance_mean", 1).first().j == 0
    assert importance.overlap(summary.where("j < 2"), summary.where("j > 0")) == 1
    with pytest.raises(ValueError):
        s.model_class_reliance(df, perm_mode="other")
    x[:, 1] = 0.95 * x[:, 0] + 0.05 * x[:, 1]
    pairs = importance.collinear_pairs(frame(spark, x, x[:, 2]), FeatureSpec(names(6))).collect()
    assert [(r.i, r.j) for r in pairs] == [(0, 1)] and pairs[0].r == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])


def test_thresholds(spark):
    s, df, x, y = fitted(spark)
    m = np.sort((x @ s.coef_)[y == 0])
    assert s.compute_threshold() == 0 and s.compute_threshold(value=0.7) == pytest.approx(math.log(0.7 / 0.3))
    assert s.compute_threshold(df, "match_prevalence") == pytest.approx(math.log(y.mean() / (1 - y.mean())))
    index = min(max(int(0.95 * len(m)), 0), len(m) - 1)
    assert s.compute_threshold(df, "match_fpr") == pytest.approx(m[index])
    best, tau = -2, None
    margins = x @ s.coef_
    for i in range(1, 100):
        t = np.percentile(margins, i)
        j = np.mean(margins[y == 1] >= t) + np.mean(margins[y == 0] < t) - 1
        if j > best + 1e-12:
            best, tau = j, t
    assert s.compute_threshold(df, "youden") == pytest.approx(tau)
    for bad in ({"value": 1.0}, {"mode": "other"}, {"mode": "youden"}):
        with pytest.raises(ValueError):
            s.compute_threshold(**bad)
    one = df.withColumn("y", F.lit(1.0))
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert s.compute_threshold(one, "match_fpr") == 0 and s.compute_threshold(one, "match_prevalence") == 0
        assert sum("0 is used" in str(x.message) for x in w) == 2


def test_order_statistics_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(order, "BINS", 4)
    monkeypatch.setattr(order, "FEW_BINS", 3)
    monkeypatch.setattr(order, "CELLS", 5)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=90), np.full(60, 0.25), np.repeat(rng.normal(size=20) * 1e-300, 3), [1e300, -1e300]])
    df = spark.createDataFrame([(i, float(v), None if i % 5 == 0 else i % 3) for i, v in enumerate(values)] + [(999, None, 1)], "id long, v double, g int")
    assert order.order_statistics(df, "v", [17]) == [np.sort(values)[17]]
    places = [0, 3, 100, 101, 170, len(values) - 1, 10**6, -5]
    assert order.order_statistics(df, "v", places) == np.sort(values)[np.clip(places, 0, len(values) - 1)].tolist()
    assert order.quantiles(df, "v", [0.1, 0.5, 0.77]) == pytest.approx(np.quantile(values, [0.1, 0.5, 0.77]).tolist())
    assert order.order_statistics(df.limit(0), "v", [0, 1]) == [None, None] == order.quantiles(df.where("v is null"), "v", [0.5, 0.6])
    even = features.share_of(F.col("id"))
    for by in ([], ["g"]):
        got = order.ranked(df, by, even, [F.col("id")], "place", "n").collect()
        assert len(got) == len(values) + 1
        for r in got:
            own = [q for q in got if not by or q.g == r.g]
            before = sum((q.id * features.GOLDEN % 1, q.id) < (r.id * features.GOLDEN % 1, r.id) for q in own)
            assert (r.place, r.n) == (before + 1, len(own))


def test_odd_numbers_fail_alike(spark):
    for d in (2, 17):
        x, y = data(d=d, n=60)
        spec = FeatureSpec(names(d), "y", "row_id")
        for bad in (float("nan"), float("inf"), None):
            df = frame(spark, x, y).withColumn("x1", F.when(F.col("row_id") == 3, F.lit(bad)).otherwise(F.col("x1")))
            with pytest.raises(ValueError, match="1 rows have a null or non-finite"):
                stats.sums(spec.project(df, True), d, "logistic", np.zeros(d))


def test_multiplicity(spark):
    s, df, x, y = fitted(spark)
    out = s.multiplicity(df, which=("ambiguity", "discrepancy", "capacity"), n_samples=30, n_pairs=40)
    a, d, c = (out[k].first() for k in ("ambiguity", "discrepancy", "capacity"))
    assert a.ambiguity_rate == d.discrepancy_bound == a.n_ambiguous / 80
    assert d.mean_pair_disagreement == d.discrepancy_empirical <= d.max_pair_disagreement <= d.discrepancy_bound + 1e-12
    h = s.fitted.hessian
    assert c.log_volume == pytest.approx(math.log(4 / 3 * math.pi) - 0.5 * np.linalg.slogdet(h)[1] + 1.5 * math.log(2 * s.fitted.epsilon))
    batch = s.sample(6)
    labels = (x @ batch.T >= 0).T
    m = multiplicity.disagreement(s.fitted, df, batch)
    assert np.allclose(m, [[np.mean(p != q) for q in labels] for p in labels])
    assert s.plot_discrepancy(df, batch).count() == 36
    rates = [r.ambiguity_rate for r in multiplicity.sweep(s.fitted, df, [0.01, 0.1, 0.3, 1.0]).orderBy("rho").collect()]
    assert rates == sorted(rates) and rates[1] == a.ambiguity_rate
    assert {r["mode"] for r in multiplicity.threshold_sweep(s.fitted, df).collect()} == set(multiplicity.MODES)
    bins = s.plot_ambiguity(df).collect()
    assert sum(r.n for r in bins) == 80 and sum(r.n_ambiguous for r in bins) == a.n_ambiguous
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert s.discrepancy(df, samples=batch[:1]).first().discrepancy_empirical is None
    with pytest.raises(ValueError):
        s.multiplicity(df, which=("other",))
    p = multiplicity.ensemble(s.fitted, df, batch).orderBy("key").collect()
    assert np.allclose([r.p_ensemble for r in p], (1 / (1 + np.exp(-x @ batch.T))).mean(1))
    q = multiplicity.quality(multiplicity.ensemble(s.fitted, df, batch)).first()
    assert 0 < q.logloss_point < 1 and 0.5 < q.accuracy_ensemble <= 1
    assert multiplicity.coefficient_distance(s.fitted, s.fitted) == 0


def test_guardrails_and_validation(spark):
    x = np.vstack([np.full((30, 1), 9.0), np.full((30, 1), -9.0)])
    df = frame(spark, x, np.repeat([1.0, 0.0], 30))
    with pytest.raises(RuntimeError, match="separation"):
        NearOptimalSet(C=1e6).fit(df, ["x0"], "y")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert NearOptimalSet(C=1e6, safety_override=True).fit(df, ["x0"], "y").fitted.n == 60
    for bad in ({"C": 0}, {"C": -1}, {"reg": "l1"}, {"estimator": "tree"}, {"epsilon_mode": "x"}, {"sampler": "x"}, {"measure": "x"}):
        with pytest.raises(ValueError):
            NearOptimalSet(**bad)
    with pytest.raises(ValueError, match="null"):
        NearOptimalSet().fit(spark.createDataFrame([(1.0, 0.0), (None, 1.0)], "x0 double, y double"), ["x0"], "y")
    with pytest.raises(ValueError, match="no rows"):
        NearOptimalSet().fit(df.limit(0), ["x0"], "y")
    with pytest.raises(ValueError, match="numeric"):
        NearOptimalSet().fit(df.withColumn("t", F.lit("a")), ["t"], "y")
    with pytest.raises(RuntimeError):
        NearOptimalSet().diagnostics()
    s, sdf, *_ = fitted(spark)
    before = s.fitted
    with pytest.raises(ValueError):
        s.fit(sdf.limit(0), names(3), "y")
    assert s.fitted is before  # a failed fit changes nothing
    assert s.get_params()["epsilon"] == 0.1 and s.set_params(epsilon=0.2).fitted is None
    with pytest.raises(TypeError):
        s.set_params(other=1)


def test_epsilon_modes(spark):
    assert linalg.chi2_quantile(0.95, 6) == pytest.approx(12.591587243743977)  # a value of tables
    s, df, x, y = fitted(spark, epsilon_mode="LR_alpha", epsilon=0.05, safety_override=True)
    assert s.fitted.epsilon == pytest.approx(0.5 * linalg.chi2_quantile(0.95, 3) / 80) and s.fitted.alpha == 0.05
    for params, kind in (({"epsilon_mode": "LR_alpha_highdim"}, "linear"), ({"epsilon_mode": "LR_alpha", "bootstrap_fallback": False}, "logistic"), ({"epsilon_mode": "LR_alpha"}, "linear")):
        with pytest.warns(UserWarning):
            f, *_ = fitted(spark, kind, **params)
        assert f.fitted.epsilon == pytest.approx(0.05 * f.fitted.l_hat) and f.fitted.alpha is None
    with pytest.warns(UserWarning):
        assert fitted(spark, epsilon=2.0)[0].fitted.epsilon == pytest.approx(s.fitted.l_hat)


@pytest.mark.parametrize("scale", ["mean", "sum"])
def test_bootstrap_against_refits(spark, scale):
    s, df, x, y = fitted(spark, epsilon_mode="LR_alpha", epsilon=0.2, bootstrap_reps=12, fit_scale=scale, n=60)
    n, lam = 60, 1.0
    effective = lam if scale == "mean" else lam / n
    p = 1 / (1 + np.exp(-x @ s.coef_))
    keys = np.array([r[0] for r in df.orderBy("row_id").select(F.xxhash64("row_id")).collect()])
    ratios = []
    for b in range(12):
        labels = (calibrate._uniform(keys, np.array([b]), 1, "random")[:, 0] < p).astype(float)
        theta = s.coef_.copy()
        for _ in range(60):
            q = 1 / (1 + np.exp(-x @ theta))
            theta = theta - np.linalg.solve((x.T * (q * (1 - q))) @ x / n + effective * np.eye(3), x.T @ (q - labels) / n + effective * theta)
        ratios.append(max(objective("logistic", x, labels, s.coef_, lam) - objective("logistic", x, labels, theta, lam), 0))
    assert s.fitted.epsilon == pytest.approx(np.quantile(ratios, 0.8), abs=1e-8) and s.fitted.calibration == "bootstrap"


def test_wide_tables_sum_by_task(spark):
    x, y = data(d=20, n=120)
    df = frame(spark, x, y)
    spec = FeatureSpec(names(20), "y", "row_id")
    theta = np.linspace(-0.5, 0.5, 20)
    wide = stats.sums(spec.project(df, True), 20, "logistic", theta)
    p = 1 / (1 + np.exp(-x @ theta))
    assert np.allclose(wide.second, (x.T * (p * (1 - p))) @ x) and np.allclose(wide.first, x.T @ (p - y)) and wide.n == 120
    assert wide.least_margin == pytest.approx(((2 * y - 1) * (x @ theta)).min()) and wide.least_weight == pytest.approx((p * (1 - p)).min())
    s = NearOptimalSet().fit(df, names(20), "y", "row_id")
    half = math.sqrt(2 * s.fitted.epsilon) * np.sqrt(np.einsum("ij,jk,ik->i", x, np.linalg.inv(s.fitted.hessian), x))
    assert np.allclose([r.hi - r.margin for r in certify.scored(s.fitted, df).orderBy("key").collect()], half)


def test_streams_are_scored(spark, tmp_path):
    s, df, x, y = fitted(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scoring.start(s.fitted, stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("key").collect()
    assert got == s.probability_bands(df).orderBy("key").collect()
    with pytest.raises(ValueError):
        scoring.score_stream(s.fitted, df)


def test_preparation(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1, x , 2\n\n?, y, 3\n4, z, ?\n 5,w ,6\n7,v,8\n")
    rows = tables.csv(spark, str(tmp_path / "a.csv"), "a double, b string, c int", most=2, order=("a",)).collect()
    assert [tuple(r) for r in rows] == [(1.0, "x", 2), (5.0, "w", 6)]
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 4.0, "a"), (4, None, "c")], "k long, v double, c string")
    z = [r.v for r in features.standardised(df, ["v"]).where("v is not null").collect()]
    assert np.allclose(z, (np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4]))
    assert [r.v for r in features.imputed(df, ["v"]).orderBy("k").collect()][-1] == pytest.approx(7 / 3)
    assert features.one_hot(df, "c", ["a", "b"]).orderBy("k").select("`c=a`", "`c=b`").collect()[-1] == (0.0, 0.0)
    assert features.one_hot(df.where("c <> 'c'"), "c", drop_if_binary=True).columns[-1] == "c=b"
    assert features.by_type(df) == (["k", "v"], ["c"]) and features.existing(df, ["v", "q"]).columns == ["v"]
    assert features.without_value(df, "a").count() == 2
    assert features.stacked(df, df).count() == 8
    assert features.mixed_column(df, "m", {"k": 2.0, "v": -1.0}).first().m == 1.0
    assert [r.label for r in features.above_median(df, "k").orderBy("k").collect()] == [0.0, 0.0, 1.0, 1.0]
    marked = features.stratified(spark.range(100).withColumn("y", F.col("id") % 4), "y", "id", 0.2).groupBy("y").agg(F.sum(F.col("test").cast("int")).alias("n")).collect()
    assert {r.n for r in marked} == {5}
    a, b = features.split(spark.range(200), "id", 0.3)
    assert a.count() + b.count() == 200 and a.intersect(b).count() == 0 and 50 < b.count() < 70
    x, _ = data(d=3, n=50, corr=0.8)
    wide, share = features.principal_components(frame(spark, x, x[:, 0]), list(names(3)), 2)
    values = np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1]
    assert np.allclose(share, values[:2] / values.sum()) and wide.agg(F.var_samp("pc0")).first()[0] == pytest.approx(values[0])
    made = tables.synthetic(spark, 2000, [1.0, -2.0], seed=3, partitions=3)
    assert made.orderBy("row_id").collect() == tables.synthetic(spark, 2000, [1.0, -2.0], seed=3, partitions=1).orderBy("row_id").collect()
    mean, std = made.agg(F.avg("x0"), F.stddev("x0")).first()
    assert abs(mean) < 0.1 and abs(std - 1) < 0.1
    tables.write_json(df.limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert "7" in tables.report(spark.createDataFrame([(7,)], "a int"))
    for x_, y_ in ((np.zeros(3), np.zeros(3)), (np.zeros((3, 1)), np.zeros(2))):
        with pytest.raises(ValueError):
            tables.from_arrays(spark, x_, y_)


def test_classes_are_apart_by_their_informative_columns(spark):
    rows = tables.classification(spark, 4000, 6, 3, 2, 1.5, seed=4).collect()
    x, y = np.array([[r[f"x{j}"] for j in range(6)] for r in rows]), np.array([r.y for r in rows])
    apart = x[y == 1].mean(0) - x[y == 0].mean(0)
    assert np.allclose(apart[:3], [3, -3, 3], atol=0.2) and abs(apart[5]) < 0.2 and 0.45 < y.mean() < 0.55
    assert np.linalg.matrix_rank(x[:, :5]) == 3  # redundant columns add nothing
    again = tables.classification(spark, 4000, 6, 3, 2, 1.5, seed=4, partitions=7).collect()
    assert sorted(rows) == sorted(again)
    with pytest.raises(ValueError):
        tables.classification(spark, 10, 3, 3, 1)


def test_known_scores_and_predictions(spark):
    s, df, x, y = fitted(spark)
    batch = s.sample(3)
    rows = spark.createDataFrame([(k, float(m), float(t)) for k in range(3) for m, t in zip(x @ batch[k], y)], "sample_id int, margin double, y double")
    assert np.allclose(s.loss_gap_many(batch, margins=rows), s.loss_gap_many(batch)) and (s.contains_many(batch, margins=rows) == s.contains_many(batch)).all()
    one = rows.where("sample_id = 1")
    assert s.loss_gap(batch[1], margins=one) == pytest.approx(s.loss_gap(batch[1])) and s.contains(batch[1], margins=one) == s.contains(batch[1])
    both = {r.key: r for r in certify.predictions(s.fitted, df).collect()}
    assert all(both[r.key].prediction == r.prediction for r in s.predict(df).collect()) and all(both[r.key].p1 == r.p1 for r in s.predict_proba(df).collect())
    carried = certify.scored(s.fitted, df.withColumn("tag", F.lit("t")), ("tag",))
    assert carried.columns == ["key", "y", "margin", "lo", "hi", "tag"] and carried.where("tag = 't'").count() == len(y)
