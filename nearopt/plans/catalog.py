"""Queries over the driver's tables, each an operator on one of two designs, beside the same in SQL.

documents: labelled documents, two standardised text features, quality as the label; a logistic model.
part: standardised key and size, price in thousands as the label; a linear model.
Set-level queries use stated parameter vectors, so that SQL can follow every number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearopt.config import FeatureSpec, SetConfig
from nearopt.functions import features
from nearopt.functions.expressions import weyl
from nearopt.operators import calibrate, certify, diagnose, importance, multiplicity, oracle
from nearopt.operators import fit as fitting
from nearopt.operators import sample as draw
from nearopt.operators.stats import sums
from nearopt.sources import tables

#: Stated vectors and tolerances.
THETA, RHO = (0.9, -1.3), 0.05
BATCH = ((0.9, -1.3), (0.7, -1.2), (1.1, -1.5), (0.0, 0.0), (0.8, -1.9), (1.3, -1.1))
PART_BATCH = ((0.1, 0.0), (0.12, 0.01), (0.08, -0.02))
SHARES = (0.01, 0.05, 0.1, 0.2)
DRAWS = 60
PAIRS = ((0, 1), (0, 2), (1, 4), (2, 5), (3, 4))
REPS = 2
STEPS = (0.6180339887498949, 0.7548776662466927)
#: Bytes below which a table is dealt out to all cores before its texts are worked on.
DEALT = 256 << 20
COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

DOCS = FeatureSpec(("x0", "x1"), "y", "doc_id")
PART = FeatureSpec(("x0", "x1"), "y", "p_partkey")


# ------------------------------------------------------------------------------------------------- the designs
_kept: dict = {}


def labelled_texts(spark: SparkSession, sf: str, names: tuple[str, ...]) -> DataFrame:
    """Labelled documents: doc_id, source, lang, the text features named, quality, toxic.

    A small table is often one group of rows in one file, which one task would read alone: it is dealt out first."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    if sum(size for _, size, _ in tables.files(spark, sf, "documents")) < DEALT:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    known = features.text_features(F.col("text"))
    return docs.select("doc_id", "source", "lang", *[known[n].alias(n) for n in names]).join(tables.table(spark, sf, "labels"), "doc_id")


def text_table(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with the text features of the design: doc_id, source, lang, quality, toxic and two doubles.

    Texts are read once: the features, a few numbers a document, are persisted, those of one folder at a time and only
    while its files are the same.
    """
    key = (spark.sparkContext.applicationId, sf, *tables.files(spark, sf, "documents"), *tables.files(spark, sf, "labels"))
    if _kept.get("key") != key or not _kept["table"].storageLevel.useMemory:
        if _kept.get("key", (None,))[0] == key[0]:
            _kept["table"].unpersist()
        _kept.update(key=key, table=labelled_texts(spark, sf, ("log_length", "other_share")).persist())
    return _kept["table"]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, lang, x0, x1, y."""
    rows = features.standardised(text_table(spark, sf), ["log_length", "other_share"])
    return rows.select("doc_id", "source", "lang", F.col("log_length").alias("x0"), F.col("other_share").alias("x1"), F.col("quality").cast("double").alias("y"))


def part(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey, x0, x1, y."""
    rows = tables.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("x0"), F.col("p_size").cast("double").alias("x1"), (F.col("p_retailprice") / 1000.0).alias("y"))
    return features.standardised(rows, ["x0", "x1"])


def document_set(spark: SparkSession, sf: str) -> fitting.FittedSet:
    out = fitting.at(DOCS.project(documents(spark, sf), True), DOCS, SetConfig(), THETA)
    return out.with_epsilon(RHO * out.l_hat)


def fitted_set(spark: SparkSession, sf: str, config: SetConfig) -> fitting.FittedSet:
    """The set of a fit of the documents.

    Its penalty makes the fit unique, whatever the rows, and a large table always has a text far from the others (one
    without letters, say), whose p (1 - p) is all but 0: the guard against near separation warns of it and raises nothing.
    """
    out = fitting.fit(documents(spark, sf), DOCS, config.replace(epsilon_mode="percent_loss", safety_override=True))
    return calibrate.calibrated(fitting.replace(out, config=config))


def part_set(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> fitting.FittedSet:
    """The set of a fit; rows, if given, are those of part(), which then aren't standardised again."""
    return fitting.fit(part(spark, sf) if rows is None else rows, PART, SetConfig(estimator="linear", epsilon=RHO))


def draws(fitted: fitting.FittedSet) -> np.ndarray:
    """Even draws from the ellipsoid: angles and radii of the disc from two sequences that any engine computes."""
    k = np.arange(1, DRAWS + 1, dtype=float)
    a, b = (k * s - np.floor(k * s) for s in STEPS)
    ball = fitted.reach * np.sqrt(a)[:, None] * np.stack([np.cos(2 * math.pi * b), np.sin(2 * math.pi * b)], 1)
    return draw.placed(fitted, ball)


def even_order(key: str):
    """Permutations that SQL can repeat: ranks of key * step, with a step for each feature and replicate."""
    return lambda j, rep: weyl(F.col("key").cast("double") * (1.0 + 3.0 * j + 7.0 * rep), STEPS[0])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zeros."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return rounded(spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())))


def grid(spark: SparkSession, m: np.ndarray, name: str) -> DataFrame:
    return rounded(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], f"i int, j int, {name} double"))


# ------------------------------------------------------------------------------------------------- SQL of the designs
LAM = "1.0e0"
RAW = """raw AS (SELECT d.doc_id, d.source, d.lang, l.quality, ln(1 + CAST(length(text) AS DOUBLE)) AS f0, 1.0e0 - CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS DOUBLE) / greatest(length(text), 1) AS f1, CAST(len(list_distinct(string_split(text, ' '))) AS DOUBLE) / len(string_split(text, ' ')) AS f2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
Z = f"""{RAW}, mom AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1 FROM raw),
z AS (SELECT doc_id, source, lang, CAST(quality AS DOUBLE) AS y, (f0 - m0) / s0 AS x0, (f1 - m1) / s1 AS x1 FROM raw, mom)"""
SET = f"""{Z}, mm AS (SELECT *, {THETA[0]}e0 * x0 + ({THETA[1]}e0) * x1 AS margin FROM z),
pp AS (SELECT *, 1 / (1 + exp(-margin)) AS p, greatest(margin, 0) + ln(1 + exp(-abs(margin))) - y * margin AS loss FROM mm),
hh AS (SELECT count(*) AS n, avg(loss) + 0.5e0 * {LAM} * ({THETA[0] ** 2 + THETA[1] ** 2}e0) AS l_hat, avg(p * (1 - p) * x0 * x0) + {LAM} AS h00, avg(p * (1 - p) * x0 * x1) AS h01, avg(p * (1 - p) * x1 * x1) + {LAM} AS h11, min(p * (1 - p)) AS least_weight, min((2 * y - 1) * margin) AS least_margin FROM pp),
h AS (SELECT *, h00 * h11 - h01 * h01 AS det, {RHO}e0 * l_hat AS eps FROM hh),
b AS (SELECT pp.*, h.n, h.eps, h.l_hat, sqrt((x0 * x0 * h11 - 2 * x0 * x1 * h01 + x1 * x1 * h00) / det) AS unit, sqrt(2 * eps) * sqrt((x0 * x0 * h11 - 2 * x0 * x1 * h01 + x1 * x1 * h00) / det) AS half FROM pp, h),
s AS (SELECT *, margin - half AS lo, margin + half AS hi, (margin - half <= 0 AND margin + half >= 0) AS ambiguous FROM b)"""
PZ = """pm AS (SELECT avg(CAST(p_partkey AS DOUBLE)) AS m0, stddev_pop(CAST(p_partkey AS DOUBLE)) AS s0, avg(CAST(p_size AS DOUBLE)) AS m1, stddev_pop(CAST(p_size AS DOUBLE)) AS s1 FROM part),
z AS (SELECT p_partkey, (p_partkey - m0) / s0 AS x0, (p_size - m1) / s1 AS x1, p_retailprice / 1000.0e0 AS y FROM part, pm)"""
PSET = f"""{PZ}, g AS (SELECT count(*) AS n, sum(x0 * x0) AS g00, sum(x0 * x1) AS g01, sum(x1 * x1) AS g11, sum(x0 * y) AS c0, sum(x1 * y) AS c1, sum(y * y) AS y2 FROM z),
t AS (SELECT *, ((g11 + 1) * c0 - g01 * c1) / ((g00 + 1) * (g11 + 1) - g01 * g01) AS t0, ((g00 + 1) * c1 - g01 * c0) / ((g00 + 1) * (g11 + 1) - g01 * g01) AS t1 FROM g),
hh AS (SELECT *, (y2 - 2 * (t0 * c0 + t1 * c1) + t0 * t0 * g00 + 2 * t0 * t1 * g01 + t1 * t1 * g11) / (2 * n) + 0.5e0 * (t0 * t0 + t1 * t1) AS l_hat, g00 / n + 1 AS h00, g01 / n AS h01, g11 / n + 1 AS h11 FROM t),
h AS (SELECT *, h00 * h11 - h01 * h01 AS det, {RHO}e0 * l_hat AS eps FROM hh)"""
DRAWN = f"""k AS (SELECT CAST(range AS DOUBLE) AS k FROM range(1, {DRAWS + 1})),
disc AS (SELECT CAST(k - 1 AS INTEGER) AS sample_id, sqrt(k * {STEPS[0]}e0 - floor(k * {STEPS[0]}e0)) AS r, 2 * pi() * (k * {STEPS[1]}e0 - floor(k * {STEPS[1]}e0)) AS a FROM k),
drawn AS (SELECT sample_id, c0 + (sqrt(2 * eps) * r * cos(a) - h01 / sqrt(h00) * (sqrt(2 * eps) * r * sin(a) / sqrt(h11 - h01 * h01 / h00))) / sqrt(h00) AS a0, c1 + sqrt(2 * eps) * r * sin(a) / sqrt(h11 - h01 * h01 / h00) AS a1 FROM disc, centre)"""
DOC_DRAWS = f"{SET}, centre AS (SELECT *, {THETA[0]}e0 AS c0, {THETA[1]}e0 AS c1 FROM h), {DRAWN}"
PART_DRAWS = f"{PSET}, centre AS (SELECT h00, h01, h11, eps, t0 AS c0, t1 AS c1 FROM h), {DRAWN}"


def _values(batch) -> str:
    return ", ".join(f"({i}, {a}e0, {b}e0)" for i, (a, b) in enumerate(batch))


OBJECTIVES = f"""{SET}, batch(sample_id, a0, a1) AS (VALUES {_values(BATCH)}),
o AS (SELECT sample_id, avg(greatest(a0 * x0 + a1 * x1, 0) + ln(1 + exp(-abs(a0 * x0 + a1 * x1))) - y * (a0 * x0 + a1 * x1)) + 0.5e0 * {LAM} * (a0 * a0 + a1 * a1) AS objective FROM batch, z GROUP BY sample_id, a0, a1),
gaps AS (SELECT sample_id, objective, objective - l_hat AS loss_gap, objective - l_hat <= eps + 1e-12 AS inside FROM o, h)"""


def _r(name: str, expr: str | None = None) -> str:
    return f"round({expr or name}, 6) + 0.0e0 AS {name}"


def _mcr(mode: str) -> str:
    """Model class reliance of PART_BATCH on part, by R squared."""
    edges = "greatest(3, CAST(floor(sqrt(any_value(n))) AS BIGINT))"
    bins = {
        "conditional": f", bins AS (SELECT j, min(other) AS lo, max(other) AS hi, (max(other) - min(other)) / ({edges} - 1) AS w, {edges} AS e FROM (SELECT j, other, (SELECT count(*) FROM z) AS n FROM wide) GROUP BY j), rows AS (SELECT wide.*, CASE WHEN other >= hi THEN e WHEN w > 0 THEN least(e, CAST(floor((other - lo) / w) AS BIGINT) + 1) ELSE 1 END AS bin FROM wide JOIN bins USING (j))",
    }.get(mode, ", rows AS (SELECT *, 1 AS bin FROM wide)")
    move = "a * xp" if mode != "residual" else "c * other + a * xp - c * op"
    return f"""{PZ}, batch(sample_id, a0, a1) AS (VALUES {_values(PART_BATCH)}),
wide AS (SELECT p_partkey AS key, y, x0, x1, j, rep, CASE j WHEN 0 THEN x0 ELSE x1 END AS own, CASE j WHEN 0 THEN x1 ELSE x0 END AS other FROM z, (SELECT CAST(range AS INTEGER) AS j FROM range(0, 2)), (SELECT CAST(range AS INTEGER) AS rep FROM range(0, {REPS}))){bins},
placed AS (SELECT *, row_number() OVER (PARTITION BY j, rep, bin ORDER BY (CAST(key AS DOUBLE) * -9.0e0) * {STEPS[0]}e0 - floor((CAST(key AS DOUBLE) * -9.0e0) * {STEPS[0]}e0), key) AS here, row_number() OVER (PARTITION BY j, rep, bin ORDER BY (CAST(key AS DOUBLE) * (1.0e0 + 3.0e0 * j + 7.0e0 * rep)) * {STEPS[0]}e0 - floor((CAST(key AS DOUBLE) * (1.0e0 + 3.0e0 * j + 7.0e0 * rep)) * {STEPS[0]}e0), key) AS there FROM rows),
met AS (SELECT p.j, p.rep, p.y, p.own, p.other, q.own AS xp, q.other AS op FROM placed p JOIN placed q ON p.j = q.j AND p.rep = q.rep AND p.bin = q.bin AND p.here = q.there),
scored AS (SELECT sample_id, j, y, CASE j WHEN 0 THEN a0 ELSE a1 END AS a, CASE j WHEN 0 THEN a1 ELSE a0 END AS c, own, other, xp, op FROM met, batch),
after AS (SELECT sample_id, j, sum((y - (c * other + {move})) * (y - (c * other + {move}))) AS rss FROM scored GROUP BY sample_id, j),
total AS (SELECT count(*) AS n, var_pop(y) AS v FROM z),
before AS (SELECT sample_id, 1 - sum((y - a0 * x0 - a1 * x1) * (y - a0 * x0 - a1 * x1)) / any_value(n * v) AS base FROM z, batch, total GROUP BY sample_id),
mcr AS (SELECT sample_id, j, base, 1 - rss / (n * {REPS} * v) AS permuted, base - (1 - rss / (n * {REPS} * v)) AS importance FROM after JOIN before USING (sample_id), total)"""


def _mcr_query(mode: str) -> Callable:
    return lambda s, f: rounded(_reliance(s, f, mode))


def _reliance(s, f, mode: str) -> DataFrame:
    rows = part(s, f)
    return importance.reliance(part_set(s, f, rows), rows, PART_BATCH, REPS, perm_mode=mode, order=even_order("p_partkey"))


def _summary(s, f) -> DataFrame:
    return importance.reliance_summary(_reliance(s, f, "iid"), PART)


_SUMMARY = f"{_mcr('iid')}, summary AS (SELECT j, 'x' || j AS feature, avg(importance) AS importance_mean, stddev_pop(importance) AS importance_std, min(importance) AS importance_min, max(importance) AS importance_max FROM mcr GROUP BY j)"


def _thresholds(mode: str) -> Callable:
    return lambda s, f: one_row(s, tau=multiplicity.threshold(document_set(s, f), documents(s, f), mode))


def _newton() -> str:
    """Newton's steps as a recursive query, from 0, penalty 100 against the summed loss."""
    p = "1 / (1 + exp(-(t0 * x0 + t1 * x1)))"
    return f"""WITH RECURSIVE {Z}, steps(it, t0, t1) AS (SELECT 0, 0.0e0, 0.0e0 UNION ALL
SELECT it + 1, t0 - ((b11 * g0 - b01 * g1) / (b00 * b11 - b01 * b01)), t1 - ((b00 * g1 - b01 * g0) / (b00 * b11 - b01 * b01)) FROM (
SELECT it, t0, t1, sum(({p} - y) * x0) + 100 * t0 AS g0, sum(({p} - y) * x1) + 100 * t1 AS g1, sum({p} * (1 - {p}) * x0 * x0) + 100 AS b00, sum({p} * (1 - {p}) * x0 * x1) AS b01, sum({p} * (1 - {p}) * x1 * x1) + 100 AS b11 FROM steps, z WHERE it < 15 GROUP BY it, t0, t1) q)
SELECT {_r('theta0', 't0')}, {_r('theta1', 't1')} FROM steps WHERE it = 15"""


def _flagship_set(s, f) -> fitting.FittedSet:
    return fitted_set(s, f, SetConfig(C=0.01, epsilon=RHO))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Fit, calibrate, and certify each labelled document: its probability, its range, and whether models differ."""
    fitted = _flagship_set(spark, sf)
    return rounded(certify.bands(fitted, documents(spark, sf)).withColumnRenamed("key", "doc_id"))


def _bootstrap(s, f) -> DataFrame:
    fitted = fitted_set(s, f, SetConfig(C=0.01, epsilon=0.1, epsilon_mode="LR_alpha", bootstrap_reps=40, random_state=3))
    return one_row(s, epsilon=fitted.epsilon, alpha=fitted.alpha, calibration=fitted.calibration)


def _topk_overlap(s, f) -> DataFrame:
    rows = _summary(s, f)
    summary = s.createDataFrame(rows.collect(), rows.schema)  # a row for each feature
    return one_row(s, shared=importance.overlap(importance.top_features(summary, "importance_mean", 1), importance.top_features(summary, "importance_std", 1)))


def _ambiguity_by_source(s, f) -> DataFrame:
    rows = multiplicity.ambiguous(document_set(s, f), documents(s, f), 0.0, ("source", "lang"))
    return rounded(rows.rollup("lang", "source").agg(F.count("*").alias("n"), F.avg(F.col("ambiguous").cast("double")).alias("rate")))


def _quality_rows(s, f) -> DataFrame:
    fitted = document_set(s, f)
    return rounded(multiplicity.quality(multiplicity.ensemble(fitted, documents(s, f), BATCH)))


def _pca(s, f) -> DataFrame:
    rows, share = features.principal_components(features.standardised(tables.table(s, f, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]), ["l_quantity", "l_extendedprice"], 2)
    spread = rows.agg(F.var_samp("pc0").alias("var0"), F.var_samp("pc1").alias("var1"))
    return rounded(spread.withColumns({"share0": F.lit(float(share[0])), "share1": F.lit(float(share[1]))}))


def _gram(s, f) -> DataFrame:
    rows = features.standardised(tables.table(s, f, "lineitem").select(*COLUMNS), list(COLUMNS))
    spec = FeatureSpec(COLUMNS)
    out = sums(spec.project(rows, False).withColumn("y", F.lit(0.0)), 4, "linear", np.zeros(4))
    return grid(s, out.second / out.n, "value")


def _diagnosed(s, f) -> DataFrame:
    fitted = document_set(s, f)
    out = diagnose.sample_diagnostics(fitted, draws(fitted))
    return rounded(out.select("n_samples", "set_fidelity", "chord_mean", "chord_std", "chord_min", "chord_max", F.element_at("ess_per_param", 1).alias("ess0"), F.element_at("ess_per_param", 2).alias("ess1")))


def _samples(s, f) -> DataFrame:
    return rounded(oracle.samples_frame(s, draws(document_set(s, f))).select("sample_id", F.element_at("theta", 1).alias("a0"), F.element_at("theta", 2).alias("a1")))


def _stats_row(s, f) -> DataFrame:
    names = ("log_length", "other_share", "distinct_share")
    known = features.moments(labelled_texts(s, f, names), list(names))
    return rounded(s.createDataFrame([(c, *v) for c, v in known.items()], "feature string, mean double, std double"))


def _one_hot(s, f) -> DataFrame:
    rows = features.one_hot(tables.table(s, f, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"])
    return rows.select("doc_id", *[F.col(f"`lang={v}`").alias(f"lang_{v}") for v in ("de", "en", "es", "fr")])


def _imputed(s, f) -> DataFrame:
    rows = tables.table(s, f, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("n_chars")).cast("double").alias("n_chars"))
    return rounded(features.imputed(rows, ["n_chars"]))


def _ellipsoid_members(s, f) -> DataFrame:
    fitted = document_set(s, f)
    worst, inside = oracle.worst_member(fitted, BATCH, 0.2)
    return one_row(s, worst=worst, inside=inside)


def _chain_rows(s, f) -> DataFrame:
    fitted = part_set(s, f)
    return draw.hit_and_run(fitted, 200, chains=4, burnin=20, random_state=5)


QUERIES: dict[str, tuple[Callable, str | None]] = {
    # preparation
    "feature_stats": (_stats_row, f"WITH {RAW} SELECT 'log_length' AS feature, {_r('mean', 'avg(f0)')}, {_r('std', 'stddev_pop(f0)')} FROM raw UNION ALL SELECT 'other_share', round(avg(f1), 6) + 0.0e0, round(stddev_pop(f1), 6) + 0.0e0 FROM raw UNION ALL SELECT 'distinct_share', round(avg(f2), 6) + 0.0e0, round(stddev_pop(f2), 6) + 0.0e0 FROM raw"),
    "standardize_documents": (lambda s, f: rounded(documents(s, f).select("doc_id", "x0", "x1")), f"WITH {Z} SELECT doc_id, {_r('x0')}, {_r('x1')} FROM z"),
    "onehot_lang": (_one_hot, "SELECT doc_id, " + ", ".join(f"CASE WHEN lang = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS lang_{v}" for v in ("de", "en", "es", "fr")) + " FROM documents"),
    "impute_mean": (_imputed, "SELECT doc_id, round(coalesce(CASE WHEN lang <> 'de' THEN CAST(n_chars AS DOUBLE) END, (SELECT avg(n_chars) FROM documents WHERE lang <> 'de')), 6) + 0.0e0 AS n_chars FROM documents"),
    "above_median": (lambda s, f: features.above_median(tables.table(s, f, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "label"), "SELECT doc_id, CASE WHEN n_chars > (SELECT quantile_cont(n_chars, 0.5) FROM documents) THEN 1.0e0 ELSE 0.0e0 END AS label FROM documents"),
    "label_prevalence": (lambda s, f: features.prevalence(tables.table(s, f, "labels"), "quality"), "SELECT quality AS label, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY quality"),
    "stratified_split": (lambda s, f: features.stratified(documents(s, f), "y", "doc_id", 0.3).select("doc_id", "test"), f"SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id * {STEPS[0]}e0 - floor(doc_id * {STEPS[0]}e0), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.3e0) AS test FROM labels JOIN documents USING (doc_id)"),
    "hash_split": (lambda s, f: features.split(tables.table(s, f, "documents").select("doc_id"), "doc_id", 0.25)[1], f"SELECT doc_id FROM documents WHERE doc_id * {STEPS[0]}e0 - floor(doc_id * {STEPS[0]}e0) < 0.25e0"),
    "pca_lineitem": (_pca, "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT round((1 + abs(r)) * n / (n - 1), 6) + 0.0e0 AS var0, round((1 - abs(r)) * n / (n - 1), 6) + 0.0e0 AS var1, round((1 + abs(r)) / 2, 6) + 0.0e0 AS share0, round((1 - abs(r)) / 2, 6) + 0.0e0 AS share1 FROM c"),
    "gram_lineitem": (_gram, " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(corr({a}, {b}), 6) + 0.0e0 AS value FROM lineitem" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS))),
    "collinear_pairs": (lambda s, f: rounded(importance.collinear_pairs(tables.table(s, f, "lineitem"), FeatureSpec(COLUMNS), 0.0)), " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(corr({COLUMNS[i]}, {COLUMNS[j]}), 6) + 0.0e0 AS r FROM lineitem" for i in range(4) for j in range(i + 1, 4))),
    # fits
    "ridge_fit_part": (lambda s, f: one_row(s, n=(p := part_set(s, f)).n, theta0=float(p.theta[0]), theta1=float(p.theta[1]), l_hat=p.l_hat, epsilon=p.epsilon), f"WITH {PSET} SELECT n, {_r('theta0', 't0')}, {_r('theta1', 't1')}, {_r('l_hat')}, {_r('epsilon', 'eps')} FROM h"),
    "ridge_r2_part": (lambda s, f: one_row(s, r2=certify.score(part_set(s, f), part(s, f))), f"WITH {PSET} SELECT round(1 - sum((y - t0 * x0 - t1 * x1) * (y - t0 * x0 - t1 * x1)) / (var_pop(y) * count(*)), 6) + 0.0e0 AS r2 FROM z, t"),
    "logistic_fit_documents": (lambda s, f: one_row(s, theta0=float((p := _flagship_set(s, f)).theta[0]), theta1=float(p.theta[1])), _newton()),
    "hessian_documents": (lambda s, f: grid(s, document_set(s, f).hessian, "value"), f"WITH {SET} SELECT 0 AS i, 0 AS j, round(h00, 6) + 0.0e0 AS value FROM h UNION ALL SELECT 0, 1, round(h01, 6) + 0.0e0 FROM h UNION ALL SELECT 1, 0, round(h01, 6) + 0.0e0 FROM h UNION ALL SELECT 1, 1, round(h11, 6) + 0.0e0 FROM h"),
    "guardrails_documents": (lambda s, f: one_row(s, kappa=(p := document_set(s, f)).kappa, least_weight=p.least_weight, least_margin=p.least_margin), f"WITH {SET} SELECT {_r('kappa', '((h00 + h11) / 2 + sqrt((h00 - h11) * (h00 - h11) / 4 + h01 * h01)) / ((h00 + h11) / 2 - sqrt((h00 - h11) * (h00 - h11) / 4 + h01 * h01))')}, {_r('least_weight')}, {_r('least_margin')} FROM h"),
    # membership
    "objective_many_documents": (lambda s, f: rounded(oracle.membership(document_set(s, f), BATCH).select("sample_id", "objective")), f"WITH {OBJECTIVES} SELECT sample_id, {_r('objective')} FROM gaps"),
    "loss_gap_many": (lambda s, f: rounded(oracle.membership(document_set(s, f), BATCH).select("sample_id", "loss_gap")), f"WITH {OBJECTIVES} SELECT sample_id, {_r('loss_gap')} FROM gaps"),
    "contains_many": (lambda s, f: oracle.membership(document_set(s, f), BATCH).select("sample_id", "inside"), f"WITH {OBJECTIVES} SELECT sample_id, inside FROM gaps"),
    "members_semi": (lambda s, f: oracle.members(document_set(s, f), BATCH).select("sample_id", F.element_at("theta", 1).alias("a0"), F.element_at("theta", 2).alias("a1")), f"WITH {OBJECTIVES} SELECT sample_id, a0, a1 FROM batch SEMI JOIN (SELECT * FROM gaps WHERE inside) g USING (sample_id)"),
    "worst_objective": (_ellipsoid_members, f"WITH {OBJECTIVES} SELECT round(max(objective), 6) + 0.0e0 AS worst, max(objective) <= 1.2e0 * any_value(l_hat) + 1e-9 AS inside FROM gaps, h"),
    # certificates and predictions
    "coef_intervals_part": (lambda s, f: rounded(certify.coef_intervals(part_set(s, f))), f"WITH {PSET}, c AS (SELECT 0 AS j, 'x0' AS feature, t0 AS t, sqrt(2 * eps * h11 / det) AS half FROM h UNION ALL SELECT 1, 'x1', t1, sqrt(2 * eps * h00 / det) FROM h) SELECT j, feature, {_r('theta_hat', 't')}, {_r('lo', 't - half')}, {_r('hi', 't + half')}, {_r('width', '2 * half')}, t - half > 0 OR t + half < 0 AS certain FROM c"),
    "hacking_interval_part": (lambda s, f: one_row(s, **dict(zip(("lo", "hi"), certify.interval(part_set(s, f), [1.0, -2.0])))), f"WITH {PSET} SELECT round(t0 - 2 * t1 - sqrt(2 * eps * (h11 + 4 * h01 + 4 * h00) / det), 6) + 0.0e0 AS lo, round(t0 - 2 * t1 + sqrt(2 * eps * (h11 + 4 * h01 + 4 * h00) / det), 6) + 0.0e0 AS hi FROM h"),
    "bands_documents": (lambda s, f: rounded(certify.bands(document_set(s, f), documents(s, f)).withColumnRenamed("key", "doc_id")), f"WITH {SET} SELECT doc_id, {_r('margin')}, {_r('lo')}, {_r('hi')}, {_r('p')}, round(1 / (1 + exp(-lo)), 6) + 0.0e0 AS p_lo, round(1 / (1 + exp(-hi)), 6) + 0.0e0 AS p_hi, ambiguous FROM s"),
    "predict_documents": (lambda s, f: rounded(certify.predictions(document_set(s, f), documents(s, f)).withColumnRenamed("key", "doc_id")), f"WITH {SET} SELECT doc_id, CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END AS prediction, round(1 - p, 6) + 0.0e0 AS p0, round(p, 6) + 0.0e0 AS p1 FROM s"),
    "score_documents": (lambda s, f: one_row(s, accuracy=certify.score(document_set(s, f), documents(s, f))), f"WITH {SET} SELECT round(avg(CASE WHEN (margin > 0) = (y > 0.5) THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS accuracy FROM s"),
    # thresholds and multiplicity
    "threshold_prevalence": (_thresholds("match_prevalence"), f"WITH {Z} SELECT round(ln(avg(y) / (1 - avg(y))), 6) + 0.0e0 AS tau FROM z"),
    "threshold_fpr": (_thresholds("match_fpr"), f"WITH {SET}, neg AS (SELECT margin, row_number() OVER (ORDER BY margin) - 1 AS i, count(*) OVER () AS m FROM s WHERE y = 0) SELECT round(margin, 6) + 0.0e0 AS tau FROM neg WHERE i = least(greatest(CAST(floor(0.95e0 * m) AS BIGINT), 0), m - 1)"),
    "threshold_youden": (_thresholds("youden"), f"WITH {SET}, q AS (SELECT i, quantile FROM (SELECT unnest(range(0, 99)) AS i, unnest(quantile_cont(margin, [" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "])) AS quantile FROM s)), y AS (SELECT i, quantile, avg(CASE WHEN y = 1 THEN CASE WHEN margin >= quantile THEN 1.0e0 ELSE 0.0e0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN margin < quantile THEN 1.0e0 ELSE 0.0e0 END END) - 1 AS j FROM s, q GROUP BY i, quantile) SELECT round(quantile, 6) + 0.0e0 AS tau FROM y ORDER BY j DESC, i LIMIT 1"),
    "ambiguity_documents": (lambda s, f: multiplicity.ambiguous_keys(document_set(s, f), documents(s, f), 0.0).withColumnRenamed("key", "doc_id"), f"WITH {SET} SELECT doc_id FROM s WHERE ambiguous"),
    "ambiguity_rate": (lambda s, f: rounded(multiplicity.ambiguity(document_set(s, f), documents(s, f))), f"WITH {SET} SELECT round(avg(CAST(ambiguous AS DOUBLE)), 6) + 0.0e0 AS ambiguity_rate, CAST(sum(CAST(ambiguous AS BIGINT)) AS BIGINT) AS n_ambiguous, 0.0e0 AS threshold FROM s"),
    "ambiguity_by_source": (_ambiguity_by_source, f"WITH {SET} SELECT lang, source, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(ambiguous AS DOUBLE)), 6) + 0.0e0 AS rate FROM s GROUP BY ROLLUP (lang, source)"),
    "epsilon_sweep": (lambda s, f: rounded(multiplicity.sweep(document_set(s, f), documents(s, f), SHARES)), f"WITH {SET}, e(rho) AS (VALUES " + ", ".join(f"({r}e0)" for r in SHARES) + f") SELECT rho, {_r('epsilon', 'rho * any_value(l_hat)')}, round(avg(CASE WHEN abs(margin) <= sqrt(2 * rho * l_hat) * unit THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS ambiguity_rate FROM s, e GROUP BY rho"),
    "discrepancy_pairs": (lambda s, f: rounded(multiplicity.discrepancy(document_set(s, f), documents(s, f), BATCH, pairs=PAIRS)), f"WITH {SET}, batch(sample_id, a0, a1) AS (VALUES {_values(BATCH)}), lab AS (SELECT sample_id, doc_id, a0 * x0 + a1 * x1 >= 0 AS one FROM s, batch), pairs(a, b) AS (VALUES " + ", ".join(map(str, PAIRS)) + "), d AS (SELECT a, b, avg(CASE WHEN p.one <> q.one THEN 1.0e0 ELSE 0.0e0 END) AS d FROM pairs JOIN lab p ON p.sample_id = a JOIN lab q ON q.sample_id = b AND p.doc_id = q.doc_id GROUP BY a, b) SELECT round((SELECT avg(CAST(ambiguous AS DOUBLE)) FROM s), 6) + 0.0e0 AS discrepancy_bound, round(avg(d), 6) + 0.0e0 AS discrepancy_empirical, round(max(d), 6) + 0.0e0 AS max_pair_disagreement, round(avg(d), 6) + 0.0e0 AS mean_pair_disagreement, 0.0e0 AS threshold FROM d"),
    "discrepancy_matrix": (lambda s, f: rounded(multiplicity.disagreement_rows(document_set(s, f), documents(s, f), BATCH)), f"WITH {Z}, batch(sample_id, a0, a1) AS (VALUES {_values(BATCH)}), lab AS (SELECT sample_id, doc_id, a0 * x0 + a1 * x1 >= 0 AS one FROM z, batch) SELECT p.sample_id AS a, q.sample_id AS b, round(avg(CASE WHEN p.one <> q.one THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS disagreement FROM lab p JOIN lab q USING (doc_id) GROUP BY p.sample_id, q.sample_id"),
    "margin_histogram": (lambda s, f: rounded(multiplicity.margin_histogram(document_set(s, f), documents(s, f))), f"WITH {SET}, r AS (SELECT min(margin) AS a, (max(margin) - min(margin)) / 30 AS w FROM s) SELECT CAST(least(30, floor((margin - a) / w) + 1) AS INTEGER) AS bin, round(any_value(a) + (least(30, floor((margin - a) / w) + 1) - 1) * any_value(w), 6) + 0.0e0 AS lo, round(any_value(a) + least(30, floor((margin - a) / w) + 1) * any_value(w), 6) + 0.0e0 AS hi, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(ambiguous AS BIGINT)) AS BIGINT) AS n_ambiguous FROM s, r GROUP BY least(30, floor((margin - a) / w) + 1)"),
    "ensemble_logloss": (_quality_rows, f"WITH {SET}, batch(sample_id, a0, a1) AS (VALUES {_values(BATCH)}), e AS (SELECT doc_id, any_value(y) AS y, any_value(p) AS p, avg(1 / (1 + exp(-(a0 * x0 + a1 * x1)))) AS q FROM s, batch GROUP BY doc_id) SELECT round(avg(-(y * ln(greatest(1e-15, p)) + (1 - y) * ln(greatest(1e-15, 1 - p)))), 6) + 0.0e0 AS logloss_point, round(avg(-(y * ln(greatest(1e-15, q)) + (1 - y) * ln(greatest(1e-15, 1 - q)))), 6) + 0.0e0 AS logloss_ensemble, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS accuracy_point, round(avg(CASE WHEN (q > 0.5) = (y = 1) THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS accuracy_ensemble FROM e"),
    "capacity_part": (lambda s, f: rounded(multiplicity.capacity(part_set(s, f))), f"WITH {PSET} SELECT round(ln(pi()) - 0.5e0 * ln(det) + ln(2 * eps), 6) + 0.0e0 AS log_volume, 2.0e0 AS effective_dim, round(ln(det), 6) + 0.0e0 AS log_det_hessian FROM h"),
    # samples and importance
    "ellipsoid_samples": (_samples, f"WITH {DOC_DRAWS} SELECT sample_id, {_r('a0')}, {_r('a1')} FROM drawn"),
    "vic_part": (lambda s, f: rounded(importance.cloud_of(p := part_set(s, f), oracle.samples_frame(s, draws(p)))), f"WITH {PART_DRAWS}, v AS (SELECT 0 AS j, 'x0' AS feature, t0 AS t, a0 AS v FROM drawn, t UNION ALL SELECT 1, 'x1', t1, a1 FROM drawn, t) SELECT j, feature, {_r('theta_hat', 'any_value(t)')}, {_r('mean', 'avg(v)')}, {_r('std', 'stddev_pop(v)')}, " + ", ".join(_r(f"q{int(100 * q):02d}", f"quantile_cont(v, {q})") for q in importance.QUANTILES) + " FROM v GROUP BY j, feature"),
    "sample_diagnostics": (_diagnosed, f"WITH {DOC_DRAWS}, o AS (SELECT sample_id, avg(greatest(a0 * x0 + a1 * x1, 0) + ln(1 + exp(-abs(a0 * x0 + a1 * x1))) - y * (a0 * x0 + a1 * x1)) + 0.5e0 * {LAM} * (a0 * a0 + a1 * a1) AS objective FROM drawn, z GROUP BY sample_id, a0, a1), fid AS (SELECT avg(CASE WHEN objective - l_hat <= eps + 1e-12 THEN 1.0e0 ELSE 0.0e0 END) AS f FROM o, h), l AS (SELECT *, lag(a0) OVER (ORDER BY sample_id) AS b0, lag(a1) OVER (ORDER BY sample_id) AS b1 FROM drawn), c AS (SELECT sqrt((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1)) AS c FROM l WHERE b0 IS NOT NULL), r AS (SELECT greatest(-0.99e0, least(0.99e0, corr(a0, b0))) AS r0, greatest(-0.99e0, least(0.99e0, corr(a1, b1))) AS r1 FROM l) SELECT {DRAWS} AS n_samples, round(any_value(f), 6) + 0.0e0 AS set_fidelity, {_r('chord_mean', 'avg(c)')}, {_r('chord_std', 'stddev_pop(c)')}, {_r('chord_min', 'min(c)')}, {_r('chord_max', 'max(c)')}, round(greatest(1.0e0, {DRAWS} * (1 - any_value(r0)) / (1 + any_value(r0))), 6) + 0.0e0 AS ess0, round(greatest(1.0e0, {DRAWS} * (1 - any_value(r1)) / (1 + any_value(r1))), 6) + 0.0e0 AS ess1 FROM c, fid, r"),
    "mcr_iid": (_mcr_query("iid"), f"WITH {_mcr('iid')} SELECT sample_id, j, {_r('base')}, {_r('permuted')}, {_r('importance')} FROM mcr"),
    "mcr_residual": (_mcr_query("residual"), f"WITH {_mcr('residual')} SELECT sample_id, j, {_r('base')}, {_r('permuted')}, {_r('importance')} FROM mcr"),
    "mcr_conditional": (_mcr_query("conditional"), f"WITH {_mcr('conditional')} SELECT sample_id, j, {_r('base')}, {_r('permuted')}, {_r('importance')} FROM mcr"),
    "mcr_range": (lambda s, f: rounded(_summary(s, f)), f"WITH {_SUMMARY} SELECT j, feature, {_r('importance_mean')}, {_r('importance_std')}, {_r('importance_min')}, {_r('importance_max')} FROM summary"),
    "topk_features": (lambda s, f: importance.top_features(_summary(s, f), "importance_mean", 1).select("j", "feature"), f"WITH {_SUMMARY} SELECT j, feature FROM summary ORDER BY abs(importance_mean) DESC, j LIMIT 1"),
    "topk_overlap": (_topk_overlap, f"WITH {_SUMMARY}, a AS (SELECT j FROM summary ORDER BY abs(importance_mean) DESC, j LIMIT 1), c AS (SELECT j FROM summary ORDER BY abs(importance_std) DESC, j LIMIT 1) SELECT CAST(count(*) AS BIGINT) AS shared FROM a JOIN c USING (j)"),
    # iterative or random by nature
    "bootstrap_epsilon": (_bootstrap, None),
    "hit_and_run": (_chain_rows, None),
}
