"""Queries of sources, sinks and preparation, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.functions import features
from nearopt.functions.even import even_steps
from nearopt.plans import catalog as C
from nearopt.sources import tables
from nearopt.storage import new_path

X, Y = [[1.0, 2.5], [-3.0, 4.0], [0.5, -1.25]], [0.0, 1.0, 1.0]
MADE = 400
WEIGHTS = (0.8, -1.1)


def _odd_customers(s, f) -> DataFrame:
    """Customers with white space around names, and segments of every seventh unknown."""
    c = tables.table(s, f, "customer")
    return c.select(F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.when(F.col("c_custkey") % 7 == 0, " ?").otherwise(F.concat("c_mktsegment", F.lit(" "))).alias("segment"), F.col("c_acctbal").alias("balance"))


_ODD = "SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 7 <> 0"


def _csv(s, f) -> DataFrame:
    path = new_path(s, "customers.csv")
    _odd_customers(s, f).write.csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.csv(s, path, "name string, segment string, balance double", most=100, order=("name",))


def _json(s, f) -> DataFrame:
    path = new_path(s, "regions.json")
    tables.write_json(tables.table(s, f, "region"), path)
    return s.read.schema("r_regionkey int, r_name string").json(path)


def _report(s, f) -> DataFrame:
    text = tables.report(tables.table(s, f, "region").orderBy("r_regionkey"), 4)
    return s.createDataFrame([(i, line.strip()) for i, line in enumerate(text.split("\n"))], "i int, line string")


def _kinds(s, f) -> DataFrame:
    numeric, other = features.by_type(tables.table(s, f, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    return s.createDataFrame([(c, "numeric") for c in numeric] + [(c, "categorical") for c in other], "name string, kind string")


def _constant(s, f) -> DataFrame:
    rows = tables.table(s, f, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), F.when(F.col("lang") != "fr", F.col("n_chars")).alias("n_chars"))
    return features.imputed(rows, constants={"lang": "none", "n_chars": -1})


def _binary(s, f) -> DataFrame:
    rows = tables.table(s, f, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    out = features.one_hot(rows, "o_orderstatus", drop_if_binary=True)
    return out.select("o_orderkey", *[F.col(f"`{c}`").alias(c.replace("o_orderstatus=", "is_")) for c in out.columns if "=" in c])


def _projected(s, f) -> DataFrame:
    rows = features.standardised(tables.table(s, f, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("a"), "p_retailprice"), ["a", "p_retailprice"])
    rows, share = features.principal_components(rows, ["a", "p_retailprice"], 2)
    # The second component's weights are equal in size, so its sign is not fixed.
    return C.rounded(rows.select("p_partkey", "pc0", F.abs("pc1").alias("pc1"), F.lit(float(share[0])).alias("share")))


def _step(i: int) -> str:
    return f"{float(even_steps(i + 1)[i])!r}e0"


def _unit(i: int) -> str:
    k = f"(r + 1) * {_step(i)}"
    return f"({k} - floor({k}))"


def _normal(i: int) -> str:
    return f"sqrt(-2 * ln({_unit(2 * i)})) * cos(2 * pi() * {_unit(2 * i + 1)})"


_MADE = f"made AS (SELECT range AS row_id, CAST(range AS DOUBLE) AS r FROM range(0, {MADE}))"


def _made(kind: str) -> str:
    margin = f"{WEIGHTS[0]}e0 * x0 + ({WEIGHTS[1]}e0) * x1"
    y = f"CASE WHEN {_unit(4)} < 1 / (1 + exp(-({margin}))) THEN 1.0e0 ELSE 0.0e0 END" if kind == "logistic" else f"{margin} + 0.1e0 * {_normal(2)}"
    return f"WITH {_MADE}, x AS (SELECT row_id, r, {_normal(0)} AS x0, {_normal(1)} AS x1 FROM made) SELECT row_id, {C._r('x0')}, {C._r('x1')}, {C._r('y', y)} FROM x"


def _over(sql: str) -> str:
    """The SQL of a made table over the customers' keys."""
    return sql.replace(_MADE, "made AS (SELECT c_custkey AS row_id, CAST(c_custkey AS DOUBLE) AS r FROM customer)")


def _customers(s, f) -> DataFrame:
    return tables.table(s, f, "customer").select("c_custkey")


def _classes() -> str:
    w = [2 * ((i + 1) * features.GOLDEN % 1) - 1 for i in range(2)]
    return f"""WITH {_MADE}, t AS (SELECT row_id, r, CASE WHEN {_unit(8)} < 0.5e0 THEN 1.0e0 ELSE 0.0e0 END AS y FROM made),
x AS (SELECT *, {_normal(0)} + (2 * y - 1) * 0.7e0 AS x0, {_normal(1)} - (2 * y - 1) * 0.7e0 AS x1 FROM t)
SELECT row_id, {C._r('x0')}, {C._r('x1')}, {C._r('x2', f'{w[0]!r}e0 * x0 + ({w[1]!r}e0) * x1')}, {C._r('x3', _normal(3))}, y FROM x"""


QUERIES: dict[str, tuple[Callable, str | None]] = {
    "arrays_source": (lambda s, f: tables.from_arrays(s, np.array(X), np.array(Y)), "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {x[0]}e0, {x[1]}e0, {y}e0)" for i, (x, y) in enumerate(zip(X, Y))) + ") t(row_id, x0, x1, y)"),
    "csv_source": (_csv, f"{_ODD} ORDER BY name LIMIT 100"),
    "trimmed_customers": (lambda s, f: features.without_value(features.trimmed(_odd_customers(s, f))), _ODD),
    "first_orders": (lambda s, f: features.first_rows(tables.table(s, f, "orders").select("o_orderkey", "o_totalprice"), 50, "o_totalprice", "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50"),
    "existing_columns": (lambda s, f: features.existing(tables.table(s, f, "nation"), ["n_name", "n_missing", "n_nationkey"]), "SELECT n_name, n_nationkey FROM nation"),
    "encoded_labels": (lambda s, f: tables.table(s, f, "customer").select("c_custkey", features.encoded(F.col("c_mktsegment"), "BUILDING").alias("label")), "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0e0 ELSE 0.0e0 END AS label FROM customer"),
    "column_kinds": (_kinds, "SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_totalprice', 'numeric'), ('o_orderstatus', 'categorical'), ('o_orderpriority', 'categorical')) t(name, kind)"),
    "impute_constant": (_constant, "SELECT doc_id, CASE WHEN lang <> 'de' THEN lang ELSE 'none' END AS lang, CASE WHEN lang <> 'fr' THEN n_chars ELSE -1 END AS n_chars FROM documents"),
    "onehot_binary": (_binary, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0e0 ELSE 0.0e0 END AS is_O FROM orders WHERE o_orderstatus <> 'P'"),
    "stacked_rows": (lambda s, f: features.stacked(tables.table(s, f, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), tables.table(s, f, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))), "SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation"),
    "mixed_column": (lambda s, f: C.rounded(features.mixed_column(tables.table(s, f, "part").select("p_partkey", "p_size", "p_retailprice"), "mixed", {"p_size": 0.95, "p_retailprice": -0.05})), f"SELECT p_partkey, p_size, round(p_retailprice, 6) + 0.0e0 AS p_retailprice, {C._r('mixed', '0.95e0 * p_size - 0.05e0 * p_retailprice')} FROM part"),
    "pca_projection": (_projected, "WITH m AS (SELECT avg(CAST(p_partkey AS DOUBLE)) AS m0, stddev_pop(CAST(p_partkey AS DOUBLE)) AS s0, avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1, corr(p_partkey, p_retailprice) AS c FROM part), z AS (SELECT p_partkey, (p_partkey - m0) / s0 AS a, (p_retailprice - m1) / s1 AS b, c FROM part, m) SELECT p_partkey, round((a + b) / sqrt(2.0e0), 6) + 0.0e0 AS pc0, round(abs(a - b) / sqrt(2.0e0), 6) + 0.0e0 AS pc1, round((1 + c) / 2, 6) + 0.0e0 AS share FROM z"),
    "report_lines": (_report, "WITH r AS (SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS i, r_regionkey, r_name FROM region), w AS (SELECT CAST(greatest(length('r_name'), max(length(r_name)) FILTER (WHERE i <= 4)) AS INTEGER) AS w FROM r) SELECT 0 AS i, 'r_regionkey ' || lpad('r_name', w, ' ') AS line FROM w UNION ALL SELECT i, CAST(r_regionkey AS VARCHAR) || ' ' || lpad(r_name, w, ' ') FROM r, w WHERE i <= 4"),
    "json_sink": (_json, "SELECT r_regionkey, r_name FROM region"),
    "synthetic_logistic": (lambda s, f: C.rounded(tables.synthetic(s, MADE, WEIGHTS, numbers="even")), _made("logistic")),
    "synthetic_linear": (lambda s, f: C.rounded(tables.synthetic(s, MADE, WEIGHTS, "linear", numbers="even")), _made("linear")),
    "planted_logistic": (lambda s, f: C.rounded(tables.synthetic(s, 0, WEIGHTS, numbers="even", over=_customers(s, f))), _over(_made("logistic"))),
    "planted_linear": (lambda s, f: C.rounded(tables.synthetic(s, 0, WEIGHTS, "linear", numbers="even", over=_customers(s, f))), _over(_made("linear"))),
    "planted_classes": (lambda s, f: C.rounded(tables.classification(s, 0, 4, 2, 1, 0.7, numbers="even", over=_customers(s, f))), _over(_classes())),
    "synthetic_classes": (lambda s, f: C.rounded(tables.classification(s, MADE, 4, 2, 1, 0.7, numbers="even")), _classes()),
}
