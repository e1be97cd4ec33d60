"""Groups of rows, tables of models, mixing of chains and Lanczos directions, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearopt.config import FeatureSpec, SetConfig
from nearopt.operators import blockwalk, diagnose, ensemble, fit, groups, importance, matrixfree, oracle, record, stats, validity
from nearopt.operators import sample as draw

from test_whole_set import even, made


# ------------------------------------------------------------------------------------------------- groups
@pytest.mark.parametrize("held", [1 << 21, 1])
def test_counts_and_gaps_by_group(spark, monkeypatch, held):
    monkeypatch.setattr(groups, "HELD", held)
    s, df, x, y = made(spark, n=150)
    names = np.array(["a", "b", None, "c", "a"], object)[np.arange(150) % 5]
    df = df.withColumn("side", F.element_at(F.array(*[F.lit(v) for v in ("a", "b", None, "c", "a")]), (F.col("id") % 5 + 1).cast("int"))).withColumn("group", F.lit("clash"))
    batch, taus = draw.ellipsoid(s, 7, 2), (-0.4, 0.0)
    got = {(r.group, r.tau, r.sample_id): r for r in groups.rates(groups.counts(s, df, "side", batch, taus)).collect()}
    assert len(got) == 4 * 2 * 7
    table = {}
    for g in (None, "a", "b", "c"):
        own = np.array([n == g for n in names])
        for tau in taus:
            for i, theta in enumerate(batch):
                ones, yes = x[own] @ theta >= tau, y[own] > 0.5
                r = got[g, tau, i]
                assert (r.n, r.positives, r.selected, r.true_positives) == (own.sum(), yes.sum(), ones.sum(), (ones & yes).sum())
                table[g, tau, i] = {"selection_rate": ones.mean(), "true_positive_rate": ones[yes].mean(), "false_positive_rate": ones[~yes].mean(), "accuracy": (ones == yes).mean()}
                assert [r[m] for m in groups.RATES] == pytest.approx([table[g, tau, i][m] for m in groups.RATES])
    found = groups.gaps(groups.counts(s, df, "side", batch, taus)).collect()
    for r in found:
        rates = {g: table[g, r.tau, r.sample_id][r.metric] for g in (None, "a", "b", "c")}
        assert r.gap == pytest.approx(max(rates.values()) - min(rates.values())) and rates[r.high_group] - rates[r.low_group] == pytest.approx(r.gap)
    for r in groups.gap_ranges(s, df, "side", batch, taus).collect():
        own = {f.sample_id: f.gap for f in found if (f.tau, f.metric) == (r.tau, r.metric)}
        assert (r.gap_min, r.gap_max) == (min(own.values()), max(own.values())) and own[r.at_min] == r.gap_min and own[r.at_max] == r.gap_max


def test_a_rate_of_no_rows_is_null(spark):
    s, df, x, y = made(spark, n=60)
    rows = groups.rates(groups.counts(s, df.withColumn("side", F.col("y")), "side", s.theta[None])).collect()
    by = {r.group: r for r in rows}
    assert by["0.0"].true_positive_rate is None and by["1.0"].false_positive_rate is None and by["1.0"].accuracy == by["1.0"].selection_rate
    metrics = {r.metric for r in groups.gaps(groups.counts(s, df.withColumn("side", F.col("y")), "side", s.theta[None])).collect()}
    assert metrics == set(groups.RATES)
    assert groups.counts(s, df.limit(0).withColumn("side", F.lit("a")), "side", s.theta[None]).count() == 0


# ------------------------------------------------------------------------------------------------- tables of models
@pytest.mark.parametrize("estimator", ["linear", "logistic"])
@pytest.mark.parametrize("small", [False, True])
def test_a_table_of_models_is_a_set(spark, monkeypatch, estimator, small):
    if small:  # many blocks of both, and no broadcast
        for name, value in (("ROWS", 16), ("MODELS", 5), ("SENT", 0)):
            monkeypatch.setattr(ensemble, name, value)
    s, df, x, y = made(spark, estimator, n=90, epsilon=0.1, C=50.0)
    batch = np.concatenate([draw.ellipsoid(s, 30, 3), 3 * draw.ellipsoid(s, 6, 4)])
    models = spark.createDataFrame([(100 + i, t.tolist(), "x") for i, t in enumerate(batch)], "model_id long, theta array<double>, note string").repartition(4)
    e = ensemble.from_ensemble(models, df, s.spec, s.config)
    objective = oracle.objective_many(s, batch)
    inside = objective <= objective.min() * 1.1 + 1e-12
    got = {r.model_id - 100: r for r in e.membership().collect()}
    assert len(got) == 36 and 3 < inside.sum() < 36
    for i in range(36):
        assert (got[i].objective, got[i].loss_gap, got[i].inside) == (pytest.approx(objective[i]), pytest.approx(objective[i] - objective.min(), abs=1e-12), bool(inside[i]))
    members = batch[inside]
    for r in e.intervals().collect():
        own = members[:, r.j]
        assert (r.lo, r.hi, r.mean, r.std) == pytest.approx((own.min(), own.max(), own.mean(), own.std())) and r.certain == (own.min() > 0 or own.max() < 0) and r.feature == f"f{r.j}"
    margins = x @ members.T
    bands = {r.key: r for r in e.bands(df).collect()}
    assert len(bands) == 90 and all((bands[i].lo, bands[i].hi) == pytest.approx((margins[i].min(), margins[i].max())) for i in range(90))
    hits = (margins.min(1) < 0.1) & (margins.max(1) >= 0.1)
    assert tuple(e.ambiguity(df, 0.1).first()) == (pytest.approx(hits.mean()), hits.sum(), 0.1)
    wanted = {(r.sample_id, r.j): r for r in importance.reliance(s, df, members, 2, order=even, check_collinearity=False).collect()}
    ids = np.flatnonzero(inside).tolist()
    reliance = e.reliance(df, 2, order=even).collect()
    assert len(reliance) == len(wanted)
    for r in reliance:
        w = wanted[ids.index(r.model_id - 100), r.j]
        assert (r.base, r.permuted, r.importance) == pytest.approx((w.base, w.permuted, w.importance))


def test_tables_of_models_are_checked(spark):
    s, df, *_ = made(spark, "linear")
    schema = "model_id long, theta array<double>"
    for rows, words in (([], "no models"), ([(1, [1.0, 2.0])], "finite"), ([(1, [1.0, 2.0, float("nan")])], "finite"), ([(None, [1.0, 2.0, 3.0])], "finite"), ([(1, [1.0, 2.0, 3.0])] * 2, "share an id")):
        with pytest.raises(ValueError, match=words):
            ensemble.from_ensemble(spark.createDataFrame(rows, schema), df, s.spec, s.config)
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], schema)
    with pytest.raises(ValueError, match="no rows"):
        ensemble.from_ensemble(one, df.limit(0), s.spec, s.config)
    e = ensemble.from_ensemble(one, df, s.spec, s.config)
    assert e.ambiguity(df.limit(0)).first().ambiguity_rate == 0 and e.bands(df.withColumn("id", F.lit("a"))).count() == 120


# ------------------------------------------------------------------------------------------------- mixing
def by_lags(values):
    """R-hat and effective size by plain sums."""
    half = values.shape[1] // 2
    x = np.concatenate([values[:, :half], values[:, -half:]])
    m, n = x.shape
    within = x.var(1, ddof=1).mean()
    total = within * (n - 1) / n + x.mean(1).var(ddof=1)
    centred = x - x.mean(1, keepdims=True)
    rho = [1.0] + [1 - (within - np.mean([(c[: n - t] * c[t:]).sum() / n for c in centred])) / total for t in range(1, n)]
    tau, least, k = -1.0, np.inf, 0
    while 2 * k + 1 < n and rho[2 * k] + rho[2 * k + 1] > 0:
        least = min(least, rho[2 * k] + rho[2 * k + 1])
        tau += 2 * least
        k += 1
    return np.sqrt(total / within), m * n / max(tau, 1 / np.log10(m * n))


def test_mixing_by_all_lags(spark):
    rng = np.random.default_rng(1)
    chains = rng.normal(size=(4, 301, 5))
    for t in range(1, 301):
        chains[:, t, 1] += 0.9 * chains[:, t - 1, 1]
    chains[:, :, 2] += 3 * np.arange(4)[:, None]  # chains that don't meet
    chains[:, :, 3] = 1.5
    chains[:, ::2, 4] *= -1
    rows = [(c, t, chains[c, t].tolist()) for c in range(4) for t in range(301)] + [(0, 301 + t, [9.0] * 5) for t in range(20)]
    got = {r.j: r for r in diagnose.mixing(spark.createDataFrame(rows, "chain_id int, step int, theta array<double>").repartition(5), 12.0).collect()}
    for j in (0, 1, 2, 4):
        rhat, ess = by_lags(chains[:, :, j])
        assert (got[j].rhat, got[j].ess, got[j].ess_per_minute) == pytest.approx((rhat, ess, 5 * ess)) and (got[j].chains, got[j].draws) == (4, 1204)
    assert got[0].rhat == pytest.approx(1, abs=0.02) and got[0].ess > 900 and got[1].ess < 150 and got[2].rhat > 2
    assert got[3].rhat is None and got[3].ess == 1200
    few = diagnose.mixing(spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0])], "chain_id int, step int, theta array<double>")).first()
    assert few.rhat is None and few.ess is None and few.ess_per_minute is None


def test_the_share_of_draws_to_trust(spark):
    s, df, x, y = made(spark, "logistic", epsilon=0.5)
    batch = draw.ellipsoid(s, 300, 3)
    share = 0.8 * s.reach / validity.trust_region(s, 1.0).first().radius
    radius = validity.trust_region(s, share).first().radius
    inside = np.array([np.sqrt((t - s.theta) @ s.hessian @ (t - s.theta)) <= radius for t in batch])
    assert 0 < inside.mean() < 1 and diagnose.trust_fraction(s, batch, share) == pytest.approx(inside.mean())
    assert diagnose.trust_fraction(made(spark, "linear")[0], np.zeros((2, 3))) == 1.0


# ------------------------------------------------------------------------------------------------- Lanczos directions
def test_the_inverse_root_without_a_matrix(spark, monkeypatch):
    rng = np.random.default_rng(3)
    d, n = 200, 500
    x = rng.normal(size=(n, d)) * np.linspace(0.2, 2, d)
    columns = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns)).repartition(3)
    theta, spec = rng.normal(size=d) * 0.1, FeatureSpec(tuple(columns))
    p = 1 / (1 + np.exp(-x @ theta))
    values, q = np.linalg.eigh((x.T * (p * (1 - p))) @ x / n + 0.5 * np.eye(d))
    v = np.concatenate([rng.normal(size=(3, d)), np.zeros((1, d)), q[:, :1].T])
    passes, product = [], matrixfree.hessian_products
    monkeypatch.setattr(matrixfree, "hessian_products", lambda *a: passes.append(len(a[4])) or product(*a))
    got = matrixfree.inverse_root(df, spec, SetConfig(C=2.0), theta, v)
    assert got == pytest.approx(v @ (q * values**-0.5) @ q.T, abs=1e-6)
    assert passes[0] == 4 and len(passes) < 40  # all directions in one pass, and far fewer passes than dimensions
    assert matrixfree.inverse_root(df, spec, SetConfig(C=2.0), theta, v[0]) == pytest.approx(got[0])


# ------------------------------------------------------------------------------------------------- records
@pytest.mark.parametrize(("estimator", "d"), [("linear", 3), ("logistic", 3), ("logistic", 18)])
def test_a_fit_leaves_a_record_without_a_scan_of_its_own(spark, monkeypatch, estimator, d):
    monkeypatch.setattr(fit, "START", 60 * d)  # the start comes from half of the rows
    s, df, x, y = made(spark, estimator, d=d)
    again, row = record.recorded_fit(df, s.spec, s.config)
    r = row.first()
    assert again.theta == pytest.approx(s.theta)
    assert (r.estimator, r.d, r.n, r.seed, r.calibration) == (estimator, d, 120, 1, "percent_loss")
    assert (r.label_min, r.label_max, r.label_sum, r.kappa, r.epsilon) == pytest.approx((y.min(), y.max(), y.sum(), s.kappa, s.epsilon))
    assert r.rows_read == 120 * r.passes and (r.passes == 1 if estimator == "linear" else 1 < r.passes < 12)
    assert r.spark == spark.version and r.seconds > 0 and r.blas
    with record.recording() as outer, record.recording() as inner:
        stats.sums(s.frame, d, "linear", np.zeros(d))
    assert outer == inner and len(inner) == 1 and inner[0]["rows"] == 120
    assert record.observed(s.frame)[0] is s.frame


# ------------------------------------------------------------------------------------------------- walks by blocks
def test_blocks_of_coordinates_walk_the_same_set(spark, monkeypatch):
    monkeypatch.setattr(blockwalk, "PACK", 16)
    s, df, x, y = made(spark, "logistic", n=90, d=4, C=20.0, epsilon=0.2)
    passes, plans, losses, scores = [], [], blockwalk.losses, blockwalk.next_scores
    monkeypatch.setattr(blockwalk, "losses", lambda *a: passes.append(1) or losses(*a))

    def noted(*a):
        out = scores(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(blockwalk, "next_scores", noted)
    tables, most = set(t.name for t in spark.catalog.listTables()), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of some size
    try:
        rows = blockwalk.hit_and_run(s, 595, chains=60, block=2, burnin=8, random_state=3).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(rows) == 595 and len({(r.chain_id, r.step) for r in rows}) == 595 and max(r.step for r in rows) == 9
    batch = np.array([r.theta for r in rows])
    assert (oracle.loss_gap_many(s, batch) <= s.epsilon * (1 + 1e-6)).all()
    walked = draw.sample(s, 4000, "hitandrun", burnin=50, chains=4, random_state=2)
    spread = walked.std(0)
    assert (np.abs(batch.mean(0) - walked.mean(0)) < 0.3 * spread).all() and batch.std(0) == pytest.approx(spread, rel=0.2)
    # A move reads one block of features beside the scores, and nothing is shuffled for it; its ends cost a few passes.
    assert len(plans) == 18 and not any("Exchange" in p for p in plans)
    assert all(sum(f"b{k}:binary" in p for k in range(2)) == 1 for p in plans)
    assert len(passes) <= 6 * 18
    assert set(t.name for t in spark.catalog.listTables()) == tables
    for how in ({"block": 0}, {"chains": 0}, {"numbers": "other"}):
        with pytest.raises(ValueError, match="range"):
            blockwalk.hit_and_run(s, 10, **how)
    with pytest.raises(ValueError, match="second moments"):
        blockwalk.hit_and_run(made(spark, "linear")[0])
