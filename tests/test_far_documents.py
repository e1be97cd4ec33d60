"""Queries that fit the documents, on a table where a few texts have no letter: their p (1 - p) is all but 0."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearopt.operators import calibrate, highdim
from nearopt.operators import fit as fitting
from nearopt.plans import calls, catalog, whole_set

N = 4_000
LAM = 100.0


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A folder of tables, and the standardised features and labels in the order of doc_id."""
    folder = str(tmp_path_factory.mktemp("far"))
    k = np.arange(N)
    digits, letters = k % 21, 100 - k % 21 + k % 7
    texts = ["a" * int(a) + "1" * int(d) for a, d in zip(letters, digits)]
    texts[0], texts[1], texts[2] = "", "1234567890", ". " * 400
    y = (digits + k * 7919 % 13 - 6 < 12).astype(int)
    y[:3] = 0
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    x = np.array([(math.log1p(len(t)), 1 - t.count("a") / max(len(t), 1)) for t in texts])
    return folder, (x - x.mean(0)) / x.std(0), y.astype(float)


def solved(x, y, start=None, steps=30):
    """Newton steps against the summed loss."""
    theta = np.zeros(2) if start is None else start
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ theta))
        theta = theta - np.linalg.solve((x.T * (p * (1 - p))) @ x + LAM * np.eye(2), x.T @ (p - y) + LAM * theta)
    return theta


def value(x, y, theta):
    m = x @ theta
    return (np.logaddexp(0, m) - y * m).mean() + LAM / 2 * theta @ theta


def rows_of(query, spark, folder):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of the texts far from the others
        return query(spark, folder).collect()


def test_the_table_is_one_that_the_guard_stops(spark, far):
    folder, x, y = far
    m = x @ solved(x, y)
    assert (np.exp(-np.abs(m)) < fitting.LEAST_WEIGHT).sum() >= 2
    with pytest.raises(RuntimeError, match="separation"):
        fitting.fit(catalog.documents(spark, folder), catalog.DOCS, fitting.SetConfig(C=0.01))


def refitted(x, y, labels, share):
    """The quantile of what refits to labels drawn from the fit (a column each) gain over it."""
    theta = solved(x, y)
    drawn = (labels < 1 / (1 + np.exp(-x @ theta))[:, None]).astype(float).T
    return np.quantile([max(0.0, value(x, d, theta) - value(x, d, solved(x, d, theta))) for d in drawn], share)


def test_bootstrap_epsilon(spark, far):
    folder, x, y = far
    (row,) = rows_of(catalog.QUERIES["bootstrap_epsilon"][0], spark, folder)
    keys = np.array([r.k for r in spark.range(N).select(F.xxhash64("id").alias("k")).collect()])
    expected = refitted(x, y, calibrate._uniform(keys, np.arange(40), 3, "random"), 0.9)
    assert row.epsilon == pytest.approx(expected, abs=2e-6) and row.calibration == "bootstrap" and row.alpha == 0.1


def test_bootstrap_even(spark, far):
    folder, x, y = far
    (row,) = rows_of(calls.QUERIES["bootstrap_even"][0], spark, folder)
    expected = refitted(x, y, calibrate._uniform(np.arange(N), np.arange(calls.REPLICATES), 0, "even"), 1 - calls.ALPHA)
    assert row.epsilon == pytest.approx(expected, abs=2e-6)


def the_set(x, y):
    """theta, the value at it, the Hessian, and the tolerance of the queries."""
    theta = solved(x, y)
    p = 1 / (1 + np.exp(-x @ theta))
    return theta, value(x, y, theta), (x.T * (p * (1 - p))) @ x / N + LAM * np.eye(2), catalog.RHO * value(x, y, theta)


def test_certified_documents(spark, far):
    folder, x, y = far
    rows = sorted(rows_of(catalog.flagship, spark, folder), key=lambda r: r.doc_id)
    theta, _, hessian, epsilon = the_set(x, y)
    m, half = x @ theta, np.sqrt(2 * epsilon * np.einsum("ij,jk,ik->i", x, np.linalg.inv(hessian), x))
    assert [r.doc_id for r in rows] == list(range(N))
    for name, expected in (("margin", m), ("lo", m - half), ("hi", m + half), ("p", 1 / (1 + np.exp(-m))), ("p_lo", 1 / (1 + np.exp(half - m))), ("p_hi", 1 / (1 + np.exp(-m - half)))):
        assert np.abs(np.array([r[name] for r in rows]) - expected).max() < 2e-6, name
    assert [r.ambiguous for r in rows] == list(np.abs(m) <= half)


def test_the_fit_has_all_digits(spark, far):
    """Rows within 1e-12 of a rounding bound fall on the side where exact steps put them."""
    rows = catalog.DOCS.project(catalog.documents(spark, far[0]), True).persist()
    x0, x1, y = (c.to_numpy() for c in rows.select("x0", "x1", "y").toArrow().columns)
    x = np.stack([x0, x1], 1)
    off = []
    for penalty in (300.0, 100.0, 30.0, 10.0):
        theta, _ = fitting.solve_logistic(rows, 2, lambda n: penalty, 100)
        p = 1 / (1 + np.exp(-x @ theta))
        off.append(np.abs(np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty * np.eye(2), x.T @ (p - y) + penalty * theta)).max())
    assert max(off) < 1e-13


def test_fitted_documents(spark, far):
    folder, x, y = far
    (row,) = rows_of(calls.QUERIES["fitted_documents"][0], spark, folder)
    theta, l_hat, hessian, epsilon = the_set(x, y)
    m = x @ theta
    p = 1 / (1 + np.exp(-m))
    values = np.linalg.eigvalsh(hessian)
    assert row.n == N and row.least_weight < fitting.LEAST_WEIGHT
    for name, expected in (("l_hat", l_hat), ("theta_norm", np.linalg.norm(theta)), ("epsilon", epsilon), ("kappa", values[1] / values[0]), ("least_weight", (p * (1 - p)).min()), ("least_margin", ((2 * y - 1) * m).min())):
        assert row[name] == pytest.approx(expected, abs=2e-6), name


def test_highdim_epsilon(spark, far):
    folder, x, y = far
    (row,) = rows_of(whole_set.QUERIES["highdim_epsilon"][0], spark, folder)
    theta, _, hessian, _ = the_set(x, y)
    m = x @ theta
    p = 1 / (1 + np.exp(-m))
    leverage = np.einsum("ij,jk,ik->i", x, np.linalg.inv(hessian), x) / N
    spread = np.var(m + (p - y) * leverage / (1 - p * (1 - p) * leverage))
    gamma, factor = highdim.strength(2 / N, spread)
    assert row.calibration == "highdim"
    assert (row.kappa, row.spread, row.gamma, row.factor) == pytest.approx((2 / N, spread, gamma, factor), abs=1e-4)
    assert row.epsilon == pytest.approx(factor * -math.log(0.05) / N, abs=2e-6)  # half the chi-square quantile of two features


def test_logistic_fit_documents(spark, far):
    folder, x, y = far
    (row,) = rows_of(catalog.QUERIES["logistic_fit_documents"][0], spark, folder)
    assert (row.theta0, row.theta1) == pytest.approx(tuple(solved(x, y)), abs=2e-6)


def beside_sql(name, spark, folder):
    """The rows of a registered query and of its SQL in DuckDB, on the same tables."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return [tuple(r) for r in rows_of(entry.queries()[name], spark, folder)], con.execute(entry.oracle_sql()[name]).fetchall()


def test_fitted_documents_beside_its_sql(spark, far):
    rows, expected = beside_sql("fitted_documents", spark, far[0])
    assert rows == expected and rows[0][0] == N


def test_highdim_epsilon_solves_its_equations(spark, far):
    import __spark_entry__ as entry

    (row,) = rows_of(entry.queries()["highdim_epsilon"], spark, far[0])
    alpha, sigma, lam = highdim.system(row.kappa, row.gamma)
    assert np.abs(highdim._equations(row.kappa, row.gamma, alpha, sigma, lam)).max() < 1e-8
    assert (alpha * row.gamma) ** 2 + row.kappa * sigma**2 == pytest.approx(row.spread, abs=1e-3)  # gamma has four digits
    assert row.factor == pytest.approx(row.kappa * sigma**2 / lam, abs=2e-6) and row.factor > 1
    assert row.epsilon == pytest.approx(row.factor * -math.log(0.05) / N, abs=2e-6) and row.calibration == "highdim"


def test_logistic_fit_documents_beside_its_sql(spark, far):
    rows, expected = beside_sql("logistic_fit_documents", spark, far[0])
    assert rows == expected and len(rows) == 1
