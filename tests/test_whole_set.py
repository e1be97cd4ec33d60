"""Bounds of reliance, Shapley values, coverings, the ellipsoid's reach and many features, against plain numpy."""

import itertools
import math

import numpy as np
import pytest

from nearopt.config import FeatureSpec, SetConfig
from nearopt.functions.expressions import weyl
from nearopt.operators import covering, fit, highdim, importance, oracle, reliance_bounds, shapley, validity
from nearopt.operators import sample as draw
from pyspark.sql import functions as F

GOLDEN = 0.6180339887498949


def made(spark, estimator="logistic", n=120, d=3, seed=0, epsilon=0.05, C=1.0, **params):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 0] += 0.3
    m = x @ np.linspace(1.2, -0.8, d)
    y = (rng.random(n) < 1 / (1 + np.exp(-m))).astype(float) if estimator == "logistic" else m + 0.5 * rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, " + ", ".join(f"f{j} double" for j in range(d)) + ", y double").repartition(3)
    spec = FeatureSpec(tuple(f"f{j}" for j in range(d)), "y", "id")
    return fit.fit(df, spec, SetConfig(estimator=estimator, epsilon=epsilon, C=C, random_state=1, **params)), df, x, y


def loss(x, y, theta):
    m = x @ np.atleast_2d(theta).T
    return (np.logaddexp(0, m) - y[:, None] * m).mean(0)


def even(j, rep):
    return weyl(F.col("key").cast("double") * (1.0 + 3.0 * j + 7.0 * rep), GOLDEN)


def swapped(x, j, rep):
    """x with column j permuted as importance.permuted does with the order `even`."""
    key = np.arange(len(x), dtype=float)
    rank = lambda step: np.argsort(np.argsort((key * step * GOLDEN) % 1.0, kind="stable"), kind="stable")
    here, there = rank(1.0 - 3.0 - 7.0), rank(1.0 + 3.0 * j + 7.0 * rep)
    out = x.copy()
    out[:, j] = x[np.argsort(there), j][here]
    return out


# ------------------------------------------------------------------------------------------------- bounds of reliance
def test_minimum_in_a_ball_also_in_the_hard_case():
    rng = np.random.default_rng(2)
    for case in range(120):
        d = 1 + case % 5
        b = rng.normal(size=(d, d)) * 10.0 ** rng.integers(-3, 3)
        b = b + b.T
        if case % 3 == 1:
            b = b @ b
        g = rng.normal(size=d) * 10.0 ** rng.integers(-3, 3)
        if case % 4 == 3:  # no part along the least direction
            q = np.linalg.eigh(b)[1][:, 0]
            g = g - (q @ g) * q
        if case % 10 == 0:
            g = np.zeros(d)
        r = 10.0 ** rng.integers(-2, 2)
        u = reliance_bounds.minimum_in_ball(b, g, r)
        value = lambda u: 0.5 * np.einsum("...i,ij,...j", u, b, u) + u @ g
        assert np.linalg.norm(u) <= r * (1 + 1e-9)
        tries = rng.normal(size=(4000, d))
        tries *= r * (rng.random((4000, 1)) ** rng.choice([0.0, 1.0])) / np.linalg.norm(tries, axis=1, keepdims=True)
        near = u + rng.normal(size=(2000, d)) * 1e-3 * r
        near *= np.minimum(1, r / np.linalg.norm(near, axis=1, keepdims=True))
        assert value(u) <= min(value(tries).min(), value(near).min(), 0.0) + 1e-9 * (1 + abs(value(u)))


def test_linear_bounds_hold_every_draw_and_are_reached(spark):
    s, df, x, y = made(spark, "linear", d=3)
    batch = np.concatenate([draw.ellipsoid(s, 400, 3), draw.ellipsoid(s, 40, 4)])
    rim = draw.placed(s, s.reach * (g := np.random.default_rng(5).normal(size=(1500, 3))) / np.linalg.norm(g, axis=1, keepdims=True))
    found = reliance_bounds.bounds(s, df, 2, order=even).orderBy("j").collect()
    seen = importance.reliance(s, df, np.concatenate([batch, rim]), 2, order=even, check_collinearity=False).groupBy("j").agg(F.min("importance").alias("lo"), F.max("importance").alias("hi")).orderBy("j").collect()
    for a, b in zip(found, seen):
        assert a.reliance_min <= b.lo + 1e-12 and b.hi <= a.reliance_max + 1e-12
        assert b.lo - a.reliance_min < 0.03 * (b.hi - b.lo) and a.reliance_max - b.hi < 0.03 * (b.hi - b.lo)
        at = importance.reliance(s, df, [a.at_min, a.at_max], 2, order=even, check_collinearity=False).where(f"j = {a.j}").orderBy("sample_id").collect()
        assert [r.importance for r in at] == pytest.approx([a.reliance_min, a.reliance_max])
    exact = reliance_bounds.bounds(s, df, 2, "exact", order=even).orderBy("j").collect()
    walked = draw.sample(s, 400, "hitandrun", burnin=20, random_state=3)  # members of the set itself
    seen = importance.reliance(s, df, walked, 2, order=even, check_collinearity=False).groupBy("j").agg(F.min("importance").alias("lo"), F.max("importance").alias("hi")).orderBy("j").collect()
    for e, b in zip(exact, seen):
        assert (oracle.loss_gap_many(s, [e.at_min, e.at_max]) <= s.epsilon * (1 + 1e-9)).all()
        assert e.reliance_min <= b.lo + 1e-12 and b.hi <= e.reliance_max + 1e-12
    with pytest.raises(ValueError, match="over"):
        reliance_bounds.bounds(s, df, over="all")


def test_logistic_bounds_stay_in_the_set_and_match_a_grid(spark):
    s, df, x, y = made(spark, "logistic", d=2, n=90)
    far = np.array([[s.theta[0] + a, s.theta[1] + b] for a in np.linspace(-2.5, 2.5, 401) for b in np.linspace(-2.5, 2.5, 401)])
    inside = loss(x, y, far) + s.lam / 2 * (far * far).sum(1) - s.l_hat <= s.epsilon
    far = far[inside]
    starts = far[:: max(1, len(far) // 40)]
    found = reliance_bounds.bounds(s, df, 1, starts=np.concatenate([starts, [[50.0, 50.0]]]), order=even).orderBy("j").collect()
    for r in found:
        rise = lambda t: loss(swapped(x, r.j, 0), y, t) - loss(x, y, t)
        grid = rise(far)
        assert (oracle.loss_gap_many(s, [r.at_min, r.at_max]) <= s.epsilon * (1 + 1e-7)).all()
        assert [float(rise(r.at_min)[0]), float(rise(r.at_max)[0])] == pytest.approx([r.reliance_min, r.reliance_max])
        width = grid.max() - grid.min()
        assert r.reliance_min <= grid.min() + 0.01 * width and r.reliance_max >= grid.max() - 0.01 * width


# ------------------------------------------------------------------------------------------------- Shapley values
def by_permutations(value, d):
    out = np.zeros(d)
    for order in itertools.permutations(range(d)):
        for k, j in enumerate(order):
            out[j] += value(frozenset(order[: k + 1])) - value(frozenset(order[:k]))
    return out / math.factorial(d)


@pytest.mark.parametrize(("estimator", "score"), [("linear", "log_likelihood"), ("logistic", "log_likelihood"), ("logistic", "accuracy")])
def test_shapley_values_are_those_of_all_orders(spark, estimator, score):
    s, df, x, y = made(spark, estimator, d=4)
    batch = draw.ellipsoid(s, 5, 2)
    got = shapley.shapley(s, df, batch, score=score).collect()
    for i, theta in enumerate(batch):

        def value(known):
            m = np.where([j in known for j in range(4)], x, x.mean(0)) @ theta
            if estimator == "linear":
                return 1 - ((y - m) ** 2).mean() / y.var()
            return ((m > 0) == (y > 0.5)).mean() if score == "accuracy" else (y * m - np.logaddexp(0, m)).mean()

        own = {r.j: r.value for r in got if r.sample_id == i}
        assert [own[j] for j in range(4)] == pytest.approx(by_permutations(value, 4), abs=1e-9)
        assert sum(own.values()) == pytest.approx(value(frozenset(range(4))) - value(frozenset()))
    rows = {r.j: r for r in shapley.summary(shapley.shapley(s, df, batch, score=score), s.spec).collect()}
    assert rows[2].feature == "f2" and rows[2].value_max == pytest.approx(max(r.value for r in got if r.j == 2)) and rows[2].std_error == 0


def test_drawn_orders_come_near_the_exact_values(spark, monkeypatch):
    s, df, x, y = made(spark, "logistic", d=5)
    batch = draw.ellipsoid(s, 3, 2)
    exact = {(r.sample_id, r.j): r.value for r in shapley.shapley(s, df, batch).collect()}
    monkeypatch.setattr(shapley, "EXACT", 2)
    near = shapley.shapley(s, df, batch, pairs=24).collect()
    assert shapley.shapley(s, df, batch, pairs=24).collect() == near
    for r in near:
        assert 0 < r.std_error and abs(r.value - exact[r.sample_id, r.j]) < 5 * r.std_error + 1e-9
    for i in range(3):
        assert sum(r.value for r in near if r.sample_id == i) == pytest.approx(sum(exact[i, j] for j in range(5)))
    assert all(r.std_error is None for r in shapley.shapley(s, df, batch, pairs=1).collect())
    assert sorted(shapley.walks(4, 2, 0)[1]) == [0, 1, 2, 3] and shapley.walks(4, 2, 0)[0] == shapley.walks(4, 2, 0)[1][::-1]
    with pytest.raises(ValueError, match="score"):
        shapley.shapley(s, df, score="other")


# ------------------------------------------------------------------------------------------------- coverings
def test_differing_labels_and_coverings_against_all_draws(spark, monkeypatch):
    s, df, x, y = made(spark, n=203, epsilon=0.3)
    batch = draw.ellipsoid(s, 60, 7)
    labels = x @ batch.T >= 0.1
    wanted = (labels[:, :, None] != labels[:, None, :]).sum(0)
    for size in (8192, 50):
        monkeypatch.setattr(covering, "ROWS", size)
        counts, n = covering.differing(s, df, batch, 0.1)
        assert n == 203 and (counts == wanted).all()
    order = covering.farthest(wanted)
    taken = [i for i, _ in order]
    for k in range(1, len(taken) + 1):
        assert order[k - 1][1] == wanted[taken[:k]].min(0).max()
        if k < len(taken):
            assert wanted[taken[:k]].min(0)[taken[k]] == order[k - 1][1]
    rows = covering.capacity(s, df, batch, (0.0, 0.02, 0.2, 1.0), 0.1).collect()
    assert [r.covering_number for r in rows] == sorted([r.covering_number for r in rows], reverse=True) and rows[-1].covering_number == 1 and rows[-1].capacity == 0
    for r in rows:
        own = taken[: r.covering_number]
        assert r.radius <= r.delta and wanted[own].min(0).max() == pytest.approx(203 * r.radius)
        assert all(wanted[a, b] > r.delta * 203 for a, b in itertools.combinations(own, 2))
    assert rows[0].covering_number == len(np.unique(labels, axis=1).T)
    assert covering.capacity(s, df, batch[:1]).first().covering_number == 1
    with pytest.raises(ValueError, match="at most"):
        covering.differing(s, df, np.zeros((covering.MOST + 1, 3)))


def test_row_capacity_is_that_of_the_channel(spark):
    s, df, x, y = made(spark, epsilon=0.4)
    for r in covering.row_capacity(s, df).limit(12).collect():
        grid = np.linspace(r.p_lo, r.p_hi, 21)
        channel, weight = np.stack([grid, 1 - grid], 1), np.full(21, 1 / 21)
        for _ in range(6000):  # Blahut and Arimoto's steps
            out = weight @ channel
            gain = np.exp((channel * np.log(channel / out)).sum(1))
            weight = weight * gain / (weight @ gain)
        assert r.capacity == pytest.approx(np.log2(weight @ gain), abs=2e-4)
    assert covering.row_capacity(s.with_epsilon(0.0), df).agg(F.max("capacity")).first()[0] == 0


# ------------------------------------------------------------------------------------------------- the ellipsoid's reach
@pytest.mark.parametrize("share", [0.05, 0.5])
def test_gaps_never_exceed_the_bound(spark, share):
    s, df, x, y = made(spark, "logistic", n=150, d=3, epsilon=0.2)
    r = validity.trust_region(s, share).first()
    units = np.linalg.norm(x @ s.inverse_factor.T, axis=1)
    assert r.third_moment == pytest.approx((units**3).mean()) and r.lipschitz == pytest.approx(validity.THIRD * (np.linalg.norm(x, axis=1) ** 3).mean())
    rim = (g := np.random.default_rng(1).normal(size=(500, 3))) / np.linalg.norm(g, axis=1, keepdims=True)
    gaps = oracle.loss_gap_many(s, draw.placed(s, s.reach * rim))
    assert gaps.max() <= r.gap_bound
    inner = s.with_epsilon(r.epsilon_valid)
    assert inner.reach == pytest.approx(r.radius)
    # Up to epsilon_valid, what is beside the gradient differs from the ellipsoid's by that share at most.
    steps = draw.placed(inner, inner.reach * rim)
    gradient = x.T @ (1 / (1 + np.exp(-x @ s.theta)) - y) / len(y) + s.lam * s.theta
    curved = oracle.loss_gap_many(inner, steps) - (steps - s.theta) @ gradient
    assert np.abs(curved - inner.epsilon).max() <= share * inner.epsilon * (1 + 1e-9)
    assert r.gradient_norm == pytest.approx(float(np.linalg.norm(s.inverse_factor @ gradient)))


def test_a_linear_set_has_no_radius(spark):
    s, df, *_ = made(spark, "linear")
    r = validity.trust_region(s).first()
    assert r.radius is None and r.epsilon_valid is None and r.euclidean_radius is None and r.cubic_share == 0
    assert oracle.loss_gap_many(s, draw.ellipsoid(s, 200, 1)).max() <= r.gap_bound
    with pytest.raises(ValueError, match="share"):
        validity.trust_region(s, 0.0)


# ------------------------------------------------------------------------------------------------- many features
def test_the_system_has_the_published_solutions():
    for kappa, gamma, wanted in ((0.1, math.sqrt(5), (1.1678, 3.3466, 0.9605)), (0.2, math.sqrt(5), (1.4994, 4.7436, 3.0269))):
        assert highdim.system(kappa, gamma) == pytest.approx(wanted, abs=6e-5)
    assert highdim.factor_of(0.3, 0.0) == pytest.approx(1.5, abs=0.02)
    factors = [highdim.factor_of(k, 1.0) for k in (1e-7, 1e-4, 1e-2, 0.1, 0.2)]
    assert factors[0] == 1.0 and factors[1] == pytest.approx(1, abs=1e-3) and factors == sorted(factors)
    assert highdim.factor_of(0.6, 0.0) is None  # half as many features as rows tell all labels apart
    alpha, sigma, _ = highdim.system(0.1, 1.5)
    assert highdim.strength(0.1, (1.5 * alpha) ** 2 + 0.1 * sigma**2)[0] == pytest.approx(1.5, abs=1e-3)
    assert highdim.strength(0.1, 1e-6)[0] == 0.0
    z = np.linspace(-30, 30, 101)
    assert highdim.prox(z, 7.0) + 7.0 / (1 + np.exp(-highdim.prox(z, 7.0))) == pytest.approx(z, abs=1e-10)


def test_unseen_margins_are_those_of_fits_without_the_row(spark):
    s, df, x, y = made(spark, "logistic", n=60, d=3, C=1.0, fit_scale="mean")
    margins = []
    for i in range(60):
        rest = np.arange(60) != i
        theta = s.theta.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-x[rest] @ theta))
            g = x[rest].T @ (p - y[rest]) + 60 * s.lam * theta
            theta = theta - np.linalg.solve((x[rest].T * (p * (1 - p))) @ x[rest] + 60 * s.lam * np.eye(3), g)
        margins.append(x[i] @ theta)
    assert highdim.unseen_spread(s) == pytest.approx(np.var(margins), rel=1e-3)


def test_the_mode_with_many_features(spark):
    s, *_ = made(spark, "logistic", n=150, d=12, C=100.0, epsilon=0.05, epsilon_mode="LR_alpha_highdim")
    found = highdim.correction(s)
    assert s.calibration == "highdim" and s.alpha == 0.05 and found["kappa"] == 0.08 and found["factor"] > 1.05
    from nearopt.operators.calibrate import wilks

    assert s.epsilon == pytest.approx(found["factor"] * wilks(s, 0.05).epsilon)
    with pytest.raises(ValueError, match="logistic"):
        highdim.correction(made(spark, "linear")[0])
