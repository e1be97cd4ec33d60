"""Variable importance over the set: clouds of coefficients, and model class reliance."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.config import FeatureSpec
from nearopt.functions.expressions import columns, total
from nearopt.functions.order import ranked
from nearopt.operators import oracle
from nearopt.operators import sample as draw
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import WRITTEN_OUT, matrix, sums

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
MODES = ("iid", "residual", "conditional")
#: Correlations above this size are reported.
COLLINEAR = 0.85


def cloud(fitted: FittedSet, n_samples: int = 200, sampler: str | None = None, feature_names=None, burnin: int = 100, thin: int = 2, random_state: int | None = None, numbers: str = "random") -> DataFrame:
    """A row per coefficient over draws: j, feature, theta_hat, mean, std, q05, q25, q50, q75, q95."""
    how = {"burnin": burnin, "thin": thin} if (sampler or fitted.config.sampler).lower() == "hitandrun" else {}
    batch = draw.sample(fitted, n_samples, sampler, random_state=random_state, numbers=numbers, **how)
    return cloud_of(fitted, oracle.samples_frame(fitted.frame.sparkSession, batch), feature_names)


def cloud_of(fitted: FittedSet, samples: DataFrame, feature_names=None) -> DataFrame:
    names = list(feature_names or fitted.spec.columns)
    if len(names) != fitted.d:
        raise ValueError(f"{fitted.d} feature names are needed")
    q = F.percentile("v", F.array(*[F.lit(x) for x in QUANTILES]))
    rows = samples.select(F.posexplode("theta").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), q.alias("q"))
    at = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("j") + 1)
    return rows.select("j", at(names).alias("feature"), at([float(t) for t in fitted.theta]).alias("theta_hat"), "mean", "std", *[F.element_at("q", i + 1).alias(f"q{int(100 * x):02d}") for i, x in enumerate(QUANTILES)])


def correlations(frame: DataFrame, d: int) -> np.ndarray:
    """Correlations of the features, by one pass over first and second moments."""
    ones = sums(frame.withColumn("y", F.lit(1.0)), d, "linear", np.zeros(d))
    mean = -ones.first / ones.n  # at theta = 0 the sums of margin - y are -sum x
    cov = ones.second / ones.n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return cov / np.outer(std, std)


def _facts(frame: DataFrame, d: int) -> tuple[int, float, np.ndarray]:
    """(rows, variance of the label, correlations of the features): in one pass where moments are written out as columns."""
    xs, label = columns(d), [F.count("y"), F.var_pop("y")]
    if d > WRITTEN_OUT:
        n, var = frame.agg(*label).first()
        return n, var, correlations(frame, d)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = frame.agg(*label, *[F.avg(x) for x in xs], *[F.avg(xs[i] * xs[j]) for i, j in pairs]).first()
    n, var, mean = row[0], row[1], np.array(row[2 : 2 + d], float)
    cov = np.zeros((d, d))
    for (i, j), v in zip(pairs, row[2 + d :]):
        cov[i, j] = cov[j, i] = np.nan if v is None else v
    cov -= np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, var, cov / np.outer(std, std)


def collinear_pairs(df: DataFrame, spec: FeatureSpec, least: float = COLLINEAR) -> DataFrame:
    """(i, j, r) of the pairs of features whose correlation is larger than `least` in size."""
    r = correlations(spec.project(df, with_label=False), spec.d)
    rows = [(i, j, float(r[i, j])) for i in range(spec.d) for j in range(i + 1, spec.d) if abs(r[i, j]) > least]
    return df.sparkSession.createDataFrame(rows, "i int, j int, r double")


def _hashed(seed: int):
    """The default order: an even number from a hash of the seed, the feature, the replicate and the key."""
    return lambda j, rep: F.pmod(F.xxhash64(F.lit(seed), j, rep, F.col("key")), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _bins(frame: DataFrame, d: int):
    """The bin of (j, other): equal widths between the ends of the mean of the features but j, max(3, sqrt(n)) edges."""
    means = [total([x for i, x in enumerate(columns(d)) if i != j]) / (d - 1) if d > 1 else F.lit(0.0) for j in range(d)]
    row = frame.agg(F.count(F.lit(1)).alias("n"), *[f(m).alias(f"{name}{j}") for j, m in enumerate(means) for name, f in (("a", F.min), ("b", F.max))]).first()
    edges = max(3, int(np.sqrt(row.n)))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("j") + 1)
    low, high = [row[f"a{j}"] for j in range(d)], [row[f"b{j}"] for j in range(d)]
    width = of([None if a is None else (b - a) / (edges - 1) for a, b in zip(low, high)])
    at = F.least(F.lit(edges), F.floor((F.col("other") - of(low)) / width).cast("int") + 1)
    return F.when(F.col("other") >= of(high), F.lit(edges)).when(width > 0, at).otherwise(F.lit(1))


def permuted(frame: DataFrame, d: int, mode: str, n_permutations: int, order=None, seed: int = 0, carry: bool = False) -> DataFrame:
    """Rows for each feature and replicate: j, rep, y, x (array) and xp, the feature's value in the row that the
    permutation puts here; with carry also source, that row's features.

    A permutation sends the row of a rank in one order to the row of this rank in another.  order(j, rep) is a column
    spread over [0, 1), whose order, ties by key, ranks the rows; j = rep = -1 stands for where values go.  The default is
    a hash.  `conditional` permutes within equal-width bins of the mean of the other features.  Ranks are taken in cells
    of the orders (see ranked), so no task holds a replicate; the rows themselves aren't copied by replicate before they
    meet the values that come to them.
    """
    order, key = order or _hashed(seed), F.col("key")
    wide = frame.select("key", "y", F.array(*columns(d)).alias("x"))
    here, by = wide, []
    there = wide.drop("y").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    if mode == "conditional":
        here = here.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
        other = F.aggregate(F.transform("x", lambda v, i: F.when(i == F.col("j"), F.lit(0.0)).otherwise(v)), F.lit(0.0), lambda s, v: s + v) / max(d - 1, 1)
        bins = _bins(frame, d)
        here, there = (df.withColumn("other", other).withColumn("bin", bins).drop("other") for df in (here, there))
        by = ["j", "bin"]
    there = there.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    there = there.select(*dict.fromkeys(["j", "rep", *by]), "key", F.element_at("x", F.col("j") + 1).alias("xp"), *([F.col("x").alias("source")] if carry else []))
    here = ranked(here, by, order(F.lit(-1), F.lit(-1)), [key]).drop("key")
    there = ranked(there, [*dict.fromkeys(["j", "rep", *by])], order(F.col("j"), F.col("rep")), [key]).drop("key")
    return here.join(there, [*by, "rank"]).select("j", "rep", "y", "x", "xp", *(["source"] if carry else []))


def reliance(fitted: FittedSet, df: DataFrame, batch=None, n_permutations: int = 16, n_samples: int = 100, perm_mode: str = "iid", check_collinearity: bool = True, sampler: str = "ellipsoid", random_state: int | None = None, order=None) -> DataFrame:
    """(sample_id, j, base, permuted, importance): how much each draw's score falls when a feature is permuted.

    Scores are accuracy (margin above 0) or R squared.  All draws share a permutation, so each permuted row is scored
    once for all of them: its new margin differs from the old by one product, and no copy of the row is changed.
    `residual` permutes what is left of a feature beside the other features' part of the margin.
    """
    if perm_mode not in MODES:
        raise ValueError(f"perm_mode must be one of {', '.join(MODES)}")
    spec, d = fitted.spec, fitted.d
    frame = spec.project(df, with_label=True)
    n, var, r = _facts(frame, d)
    if check_collinearity:
        high = [(i, j) for i in range(d) for j in range(i + 1, d) if abs(r[i, j]) > COLLINEAR]
        if high:
            warnings.warn(f"collinear features {high}; their importances are shared", stacklevel=2)
    seed = fitted.config.random_state if random_state is None else random_state
    batch = draw.sample(fitted, n_samples, sampler, random_state=seed) if batch is None else oracle.thetas(batch, d)
    logistic = fitted.config.estimator == "logistic"
    k = len(batch)

    def hits(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
        if logistic:
            return ((margins > 0) == (y[:, None] > 0.5)).sum(0).astype(float)
        return ((y[:, None] - margins) ** 2).sum(0)

    def base(batches):
        out = np.zeros(k)
        for rows in batches:
            out += hits(matrix(rows, d) @ batch.T, rows.column(rows.schema.get_field_index("y")).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.full(k, -1)), pa.array(out)], ["sample_id", "j", "hits"])

    def changed(batches):
        out = np.zeros((d, k))
        for rows in batches:
            x = rows.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y, j, xp = rows.column(2).to_numpy(), rows.column(0).to_numpy(), rows.column(4).to_numpy()
            margins = x @ batch.T
            for f in np.unique(j):
                own = j == f
                t = batch[:, f][None, :]
                new = margins[own] + t * (xp[own, None] - x[own, f][:, None])
                if perm_mode == "residual":
                    # Others' part of the margin here and in the row that xp comes from: the residuals are swapped.
                    here = margins[own] - t * x[own, f][:, None]
                    source = rows.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)[own]
                    there = source @ batch.T - t * source[:, f][:, None]
                    new = 2 * here + t * xp[own, None] - there
                out[f] += hits(new, y[own])
        names = np.indices((d, k))
        yield pa.RecordBatch.from_arrays([pa.array(names[1].ravel()), pa.array(names[0].ravel()), pa.array(out.ravel())], ["sample_id", "j", "hits"])

    rows = permuted(frame, d, perm_mode, n_permutations, order, 0 if seed is None else int(seed), carry=perm_mode == "residual")
    schema = "sample_id long, j long, hits double"
    counted = frame.mapInArrow(base, schema).unionByName(rows.mapInArrow(changed, schema)).groupBy("sample_id", "j").agg(F.sum("hits").alias("hits"))
    rows_of = F.lit(float(n)) * F.when(F.col("j") < 0, 1).otherwise(n_permutations)
    if logistic:
        value = F.col("hits") / rows_of
    else:
        value = 1.0 - F.col("hits") / (rows_of * F.lit(float(var))) if var > 0 else F.when(F.col("hits") <= 0, 1.0).otherwise(0.0)
    scores = counted.withColumn("score", value)
    first = scores.where("j < 0").select("sample_id", F.col("score").alias("base"))
    out = scores.where("j >= 0").join(F.broadcast(first), "sample_id")  # a row per draw
    return out.select(F.col("sample_id").cast("int").alias("sample_id"), F.col("j").cast("int").alias("j"), "base", F.col("score").alias("permuted"), (F.col("base") - F.col("score")).alias("importance"))


def reliance_summary(matrix_rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """A row per feature over draws: j, feature, importance_mean, importance_std, importance_min, importance_max."""
    name = F.element_at(F.array(*[F.lit(c) for c in spec.columns]), F.col("j") + 1)
    v = "importance"
    return matrix_rows.groupBy("j").agg(F.avg(v).alias("importance_mean"), F.stddev_pop(v).alias("importance_std"), F.min(v).alias("importance_min"), F.max(v).alias("importance_max")).select("j", name.alias("feature"), "importance_mean", "importance_std", "importance_min", "importance_max")


def top_features(summary: DataFrame, by: str, k: int) -> DataFrame:
    """The k features of largest size in a column, ties by j."""
    return summary.orderBy(F.abs(F.col(by)).desc(), "j").limit(k)


def overlap(first: DataFrame, second: DataFrame) -> int:
    """Features that two rankings share."""
    return first.select("j").intersect(second.select("j")).count()
