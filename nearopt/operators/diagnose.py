"""How good a sampling is: fidelity, moves, isotropy, effective size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearopt.operators import oracle
from nearopt.operators.fit import FittedSet

SCHEMA = "n_samples int, set_fidelity double, chord_mean double, chord_std double, chord_min double, chord_max double, isotropy_ratio double, ess_per_param array<double>"


def chords(samples: DataFrame) -> DataFrame:
    """(chord_mean, chord_std, chord_min, chord_max) of the steps between neighbours of a chain."""
    before = F.lag("theta").over(Window.partitionBy("chain_id").orderBy("step"))
    square = F.aggregate(F.zip_with("theta", "before", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    steps = samples.withColumn("before", before).where("before is not null").select(F.sqrt(square).alias("c"))
    return steps.agg(F.avg("c").alias("chord_mean"), F.stddev_pop("c").alias("chord_std"), F.min("c").alias("chord_min"), F.max("c").alias("chord_max"))


def effective_size(samples: DataFrame) -> DataFrame:
    """(j, ess): per coefficient, summed over chains: n (1 - r) / (1 + r) for the correlation r of neighbours, which is
    clipped to 0.99 in size; at least 1; n where a chain doesn't vary."""
    flat = samples.select("chain_id", "step", F.posexplode("theta").alias("j", "v"))
    flat = flat.withColumn("before", F.lag("v").over(Window.partitionBy("chain_id", "j").orderBy("step")))
    each = flat.groupBy("chain_id", "j").agg(F.count("*").alias("n"), F.var_pop("v").alias("var"), F.corr("before", "v").alias("r"))
    r = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("r")))
    ess = F.when(F.col("var") <= 1e-12, F.col("n").cast("double")).otherwise(F.greatest(F.lit(1.0), F.col("n") * (1 - r) / (1 + r)))
    return each.withColumn("ess", ess).groupBy("j").agg(F.sum("ess").alias("ess")).orderBy("j")


def isotropy(batch: np.ndarray) -> float | None:
    """Largest over smallest eigenvalue of the draws' covariance, zeros left out."""
    if len(batch) < batch.shape[1] + 1:
        return None
    values = np.linalg.eigvalsh(np.atleast_2d(np.cov(batch, rowvar=False)))
    values = values[values > 1e-12]
    return float(values[-1] / values[0]) if len(values) >= 2 else None


def sample_diagnostics(fitted: FittedSet, samples, burnin: int = 0, compute_ess: bool = True, compute_isotropy: bool = True) -> DataFrame:
    """One row on draws, a (k, d) array or a frame (chain_id, step, theta); fields that can't be had are null."""
    spark = fitted.frame.sparkSession
    if not isinstance(samples, DataFrame):
        batch = oracle.thetas(samples, fitted.d)
        samples = spark.createDataFrame([(0, i, [float(v) for v in row]) for i, row in enumerate(batch)], "chain_id int, step int, theta array<double>")
    samples = samples.where(F.col("step") >= burnin)
    batch = np.array([r.theta for r in samples.orderBy("chain_id", "step").select("theta").collect()])  # draws are few
    if len(batch) < 2:
        return spark.createDataFrame([(len(batch), *[None] * 7)], SCHEMA)
    fidelity = float(oracle.contains_many(fitted, batch).mean())
    c = chords(samples).first()
    ess = [r.ess for r in effective_size(samples).collect()] if compute_ess and len(batch) >= 10 else None
    return spark.createDataFrame([(len(batch), fidelity, c.chord_mean, c.chord_std, c.chord_min, c.chord_max, isotropy(batch) if compute_isotropy else None, ess)], SCHEMA)


def _mixing(values: np.ndarray) -> tuple[float | None, float | None]:
    """(R-hat, effective size) of chains (m, n), each split in halves: Stan's estimators, by autocovariances at all lags."""
    half = values.shape[1] // 2
    x = np.concatenate([values[:, :half], values[:, values.shape[1] - half :]])
    m, n = x.shape
    if n < 2:
        return None, None
    mean = x.mean(1, keepdims=True)
    centred = x - mean
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(centred, size, axis=1)
    cov = np.fft.irfft(f * f.conj(), size, axis=1)[:, :n] / n
    within = float(cov[:, 0].mean()) * n / (n - 1)
    both = within * (n - 1) / n + float(mean.var(ddof=1))
    if not within > 0:
        return None, float(m * n)
    rho = 1 - (within - cov.mean(0)) / both
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    last = int(np.argmax(pairs <= 0)) if (pairs <= 0).any() else len(pairs)
    tau = -1 + 2 * float(np.minimum.accumulate(pairs[:last]).sum())
    return float(np.sqrt(both / within)), m * n / max(tau, 1 / np.log10(max(m * n, 2)))


def mixing(samples: DataFrame, seconds: float | None = None) -> DataFrame:
    """(j, chains, draws, rhat, ess, ess_per_minute) of each coefficient over chains (chain_id, step, theta).

    Chains are cut to the length of the shortest and split in halves.  rhat compares the halves' spread with that within
    them: 1 where they agree.  ess counts independent draws by the correlations at all lags, pairs of which are added up
    while they are positive, no pair counting more than the one before.  seconds is how long the draws took.  Fields that
    can't be had are null: of halves of one draw, of coefficients that don't vary.  A task holds one coefficient's draws.
    """

    def of(key, frame):
        chains = [own.sort_values("step")["v"].to_numpy() for _, own in frame.groupby("chain_id")]
        n = min(map(len, chains))
        rhat, ess = _mixing(np.stack([c[:n] for c in chains]))
        rate = None if ess is None or not seconds else 60.0 * ess / seconds
        return pd.DataFrame({"j": [int(key[0])], "chains": [len(chains)], "draws": [n * len(chains)], "rhat": [rhat], "ess": [ess], "ess_per_minute": [rate]}).astype({"rhat": "float64", "ess": "float64", "ess_per_minute": "float64"})

    rows = samples.select("chain_id", "step", F.posexplode("theta").alias("j", "v"))
    nulls = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c)
    return rows.groupBy("j").applyInPandas(of, "j int, chains int, draws int, rhat double, ess double, ess_per_minute double").select("j", "chains", "draws", *[nulls(c) for c in ("rhat", "ess", "ess_per_minute")])


def trust_fraction(fitted: FittedSet, samples, share: float = 0.1) -> float:
    """The share of draws, a (k, d) array, that lie where the ellipsoid is right to `share` (validity.trust_region)."""
    from nearopt.operators.validity import trust_region

    radius = trust_region(fitted, share).first().radius
    steps = (oracle.thetas(samples, fitted.d) - fitted.theta) @ np.linalg.cholesky(fitted.hessian)
    return 1.0 if radius is None else float((np.linalg.norm(steps, axis=1) <= radius).mean())
