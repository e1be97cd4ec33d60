"""A set given by a table of models instead of an ellipsoid: any linear models of the same features, however they were made.

Models and rows may both be many.  Rows are packed into blocks, and so are models; every block of rows meets every block
of models, and a task turns a pair of blocks into one product of matrices and a few numbers for each model or row.  The
models' blocks are broadcast if their values are counted to be few, and else the pairs are dealt out by both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.config import FeatureSpec, SetConfig
from nearopt.operators import importance
from nearopt.operators.stats import matrix

#: Rows of a block, models of a block, and values of all models up to which they are broadcast (8 MB).
ROWS, MODELS, SENT = 4096, 512, 1_000_000


@dataclass(frozen=True, eq=False)
class EnsembleSet:
    """Models (model_id, theta) with their objectives, those within epsilon of the best being members."""

    config: SetConfig
    spec: FeatureSpec
    frame: DataFrame
    scored: DataFrame
    n_models: int
    best: float
    epsilon: float

    @property
    def members(self) -> DataFrame:
        """(model_id, theta) of the models in the set."""
        return self.scored.where(F.col("objective") <= F.lit(self.best + self.epsilon + 1e-12)).select("model_id", "theta")

    def membership(self) -> DataFrame:
        """(model_id, objective, loss_gap, inside) of all models."""
        gap = F.col("objective") - F.lit(self.best)
        return self.scored.select("model_id", "objective", gap.alias("loss_gap"), (gap <= F.lit(self.epsilon + 1e-12)).alias("inside"))

    def intervals(self) -> DataFrame:
        """(j, feature, lo, hi, mean, std, certain): each coefficient over the members; certain if its sign is the same."""
        name = F.element_at(F.array(*[F.lit(c) for c in self.spec.columns]), F.col("j") + 1)
        rows = self.members.select(F.posexplode("theta").alias("j", "v")).groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
        return rows.select("j", name.alias("feature"), "lo", "hi", "mean", "std", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("certain"))

    def bands(self, df: DataFrame) -> DataFrame:
        """(key, lo, hi): the range of each row's margin over the members."""
        rows = self.spec.project(df, with_label=False)
        d, kind = self.spec.d, dict(rows.dtypes)["key"]

        def task(batches):
            for batch in batches:
                for pair in batch.to_pylist():
                    m = _matrix(pair["x"], d) @ _matrix(pair["thetas"], d).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), pair["block"])), pa.array(np.arange(len(m))), pa.array(pair["keys"], _arrow(kind)), pa.array(m.min(1)), pa.array(m.max(1))], ["block", "at", "key", "lo", "hi"])

        pairs = _met(_row_blocks(rows, d, keyed=kind), _model_blocks(self.members, self.n_models), self.n_models * d)
        out = pairs.mapInArrow(task, f"block long, at long, key {kind}, lo double, hi double")
        return out.groupBy("block", "at").agg(F.first("key").alias("key"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("key", "lo", "hi")

    def ambiguity(self, df: DataFrame, tau: float = 0.0) -> DataFrame:
        """One row: ambiguity_rate, n_ambiguous, threshold: rows that one member labels 1 (margin at or above tau) and
        another doesn't."""
        hits = ((F.col("lo") < tau) & (F.col("hi") >= tau)).cast("double")
        return self.bands(df).agg(F.coalesce(F.avg(hits), F.lit(0.0)).alias("ambiguity_rate"), F.coalesce(F.sum(hits), F.lit(0.0)).cast("long").alias("n_ambiguous"), F.lit(tau).alias("threshold"))

    def reliance(self, df: DataFrame, n_permutations: int = 16, order=None, random_state: int = 0) -> DataFrame:
        """(model_id, j, base, permuted, importance) of the members: how much the score falls when a feature is permuted,
        as in importance.reliance, permutations included."""
        frame, d = self.spec.project(df, with_label=True), self.spec.d
        moved = importance.permuted(frame, d, "iid", n_permutations, order, random_state)
        swapped = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.col("xp")).otherwise(v))
        xs = lambda x: [F.element_at(x, k + 1).alias(f"x{k}") for k in range(d)]
        rows = moved.select("j", "y", swapped.alias("z")).select(*xs("z"), "y", F.col("j").cast("int").alias("j"))
        rows = rows.unionByName(frame.select(*[f"x{k}" for k in range(d)], "y", F.lit(-1).alias("j")))
        sums = _sums(rows, self.members, self.n_models, d, self.config.estimator)
        if self.config.estimator == "logistic":
            score = F.col("hits") / F.col("n")
        else:
            var = frame.agg(F.var_pop("y")).first()[0]
            score = 1.0 - F.col("square") / (F.col("n") * F.lit(float(var))) if var and var > 0 else F.when(F.col("square") <= 0, 1.0).otherwise(0.0)
        scores = sums.withColumn("score", score)
        base = scores.where("j < 0").select("model_id", F.col("score").alias("base"))
        out = scores.where("j >= 0").join(base, "model_id")
        return out.select("model_id", "j", "base", F.col("score").alias("permuted"), (F.col("base") - F.col("score")).alias("importance"))


def _matrix(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, d)


def _arrow(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}.get(kind, pa.int64())


def _row_blocks(rows: DataFrame, d: int, keyed: str | None = None) -> DataFrame:
    """(block, x, [y, js] or [keys]): ROWS rows at most in each, matrices as bytes."""

    def pack(batches):
        for batch in batches:
            x = matrix(batch, d)
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a in range(0, len(x), ROWS):
                part = np.ascontiguousarray(x[a : a + ROWS]).tobytes()
                if keyed:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary()), pa.array([get("key").slice(a, ROWS).to_pylist()], pa.list_(_arrow(keyed)))], ["x", "keys"])
                else:
                    y, j = get("y").slice(a, ROWS).to_numpy(zero_copy_only=False).astype(float), get("j").slice(a, ROWS).to_numpy().astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (part, y.tobytes(), j.tobytes())], ["x", "y", "js"])

    out = rows.mapInArrow(pack, f"x binary, keys array<{keyed}>" if keyed else "x binary, y binary, js binary")
    return out.withColumn("block", F.monotonically_increasing_id())


def _model_blocks(models: DataFrame, n: int) -> DataFrame:
    """(ids, thetas) of some MODELS models each; the ids are distinct, so a hash deals them evenly."""
    parts = max(1, -(-n // MODELS))
    own = F.array_sort(F.collect_list(F.struct("model_id", "theta")))
    rows = models.groupBy(F.pmod(F.xxhash64("model_id"), F.lit(parts)).alias("part")).agg(own.alias("m"))

    def pack(batches):
        for batch in batches:
            for m in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([[r["model_id"] for r in m]], pa.list_(pa.int64())), pa.array([np.array([r["theta"] for r in m], float).tobytes()], pa.binary())], ["ids", "thetas"])

    return rows.select("m").mapInArrow(pack, "ids array<long>, thetas binary")


def _met(rows: DataFrame, models: DataFrame, values: int) -> DataFrame:
    """Every block of rows with every block of models."""
    return rows.crossJoin(F.broadcast(models) if values <= SENT else models)


def _sums(rows: DataFrame, models: DataFrame, n_models: int, d: int, estimator: str) -> DataFrame:
    """(model_id, j, n, loss, hits, square) over rows (x0 .., y, j): sums by model and j."""

    def task(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                m = _matrix(pair["x"], d) @ _matrix(pair["thetas"], d).T
                y, js = np.frombuffer(pair["y"]), np.frombuffer(pair["js"], np.int32)
                off = (y[:, None] - m) ** 2
                loss = np.logaddexp(0.0, m) - y[:, None] * m if estimator == "logistic" else off / 2
                for j in np.unique(js):
                    own = js == j
                    k = m.shape[1]
                    hits = ((m[own] > 0) == (y[own, None] > 0.5)).sum(0).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(pair["ids"], pa.int64()), pa.array(np.full(k, j, np.int32)), pa.array(np.full(k, int(own.sum()))), pa.array(loss[own].sum(0)), pa.array(hits), pa.array(off[own].sum(0))], ["model_id", "j", "n", "loss", "hits", "square"])

    pairs = _met(_row_blocks(rows, d), _model_blocks(models, n_models), n_models * d)
    out = pairs.mapInArrow(task, "model_id long, j int, n long, loss double, hits double, square double")
    return out.groupBy("model_id", "j").agg(*[F.sum(c).alias(c) for c in ("n", "loss", "hits", "square")])


def from_ensemble(models: DataFrame, df: DataFrame, spec: FeatureSpec, config: SetConfig | None = None, id_col: str = "model_id", theta_col: str = "theta") -> EnsembleSet:
    """The set of the models within a share config.epsilon of the best one's objective on df.

    models has an id and an array of coefficients in the order of spec.columns, a row for each; the objective is the mean
    loss and the penalty of config, as for fitted sets.  Ids must be distinct and not null, and arrays complete.
    """
    config = config or SetConfig()
    models = models.select(F.col(f"`{id_col}`").cast("long").alias("model_id"), F.col(f"`{theta_col}`").cast("array<double>").alias("theta"))
    d = spec.d
    fine = F.col("model_id").isNotNull() & (F.size("theta") == d) & F.forall("theta", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    n, good, ids = models.agg(F.count(F.lit(1)), F.count(F.when(fine, 1)), F.count_distinct("model_id")).first()
    if not n:
        raise ValueError("there are no models")
    if good < n or ids < n:
        raise ValueError(f"{n - good} models have no id or not {d} finite coefficients, and {good - ids} share an id")
    frame = spec.project(df, with_label=True)
    loss = _sums(frame.select(*[f"x{k}" for k in range(d)], "y", F.lit(-1).alias("j")), models, n, d, config.estimator)
    if not loss.take(1):
        raise ValueError("there are no rows")
    square = F.aggregate("theta", F.lit(0.0), lambda s, v: s + v * v)
    scored = models.join(loss.select("model_id", (F.col("loss") / F.col("n")).alias("mean")), "model_id").select("model_id", "theta", (F.col("mean") + config.lam / 2 * square).alias("objective")).persist()
    best = scored.agg(F.min("objective")).first()[0]
    return EnsembleSet(config, spec, frame, scored, n, best, config.epsilon * best)
