"""Hit-and-run by blocks of coordinates, for logistic sets whose rows neither the driver nor a task can hold.

Rows are packed by the thousand, a column of bytes for each block of features, into a table that is bucketed by pack.  The
scores of all chains lie beside them in a table bucketed alike.  A move goes along directions within one block of
features, one for each chain: the packs' scores, what the last move adds to them, and the new directions' products come
from the two blocks concerned, by a join of the buckets without a shuffle, and are written as the next scores.  The ends
of the chords are then looked for in passes over these scores alone, for all chains at once.  So a move reads no whole
rows, and the driver holds a vector for each chain.
"""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.operators.fit import FittedSet
from nearopt.operators.sample import NUMBERS, SCHEMA, EvenNumbers
from nearopt.operators.stats import matrix
from nearopt.storage import dropped, new_path

#: Rows of a pack; positions at which either end is tried in a pass, of which the first are these multiples of a guess.
PACK, FIRST, INNER = 4096, (0.0, 0.5, 0.8, 1.0, 1.25, 2.0, 4.0), 5


class _Bucketed:
    """Tables bucketed by pack in the shared folder, deleted at the end."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.made = spark, buckets, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table, path = f"{name}_{uuid.uuid4().hex}", new_path(self.spark, name)
        df.write.bucketBy(self.buckets, "pack").sortBy("pack").option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out.nearopt_path, out.nearopt_table = path, table
        self.made.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        self.made.remove(df)
        self.spark.sql(f"DROP TABLE IF EXISTS {df.nearopt_table}")
        dropped(df)


def layout(frame: DataFrame, d: int, block: int) -> DataFrame:
    """(pack, y, b0, b1, ..): rows packed, each block of features a column of bytes."""
    cuts = [slice(a, min(a + block, d)) for a in range(0, d, block)]
    names = ["y", *[f"b{i}" for i in range(len(cuts))]]

    def pack(batches):
        for batch in batches:
            x, y = matrix(batch, d), batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)
            for a in range(0, len(y), PACK):
                own = x[a : a + PACK]
                values = [y[a : a + PACK].tobytes(), *[np.ascontiguousarray(own[:, c]).tobytes() for c in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names)

    return frame.mapInArrow(pack, ", ".join(f"{n} binary" for n in names)).withColumn("pack", F.monotonically_increasing_id())


def _of(batch: pa.RecordBatch, name: str, i: int, rows: int) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[i].as_py()).reshape(rows, -1)


def first_scores(table: DataFrame, theta: np.ndarray, block: int, chains: int) -> DataFrame:
    """(pack, y, z, u): all chains at theta, no directions yet: the one pass over all blocks."""

    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                y = batch.column(batch.schema.get_field_index("y"))[i].as_py()
                rows = len(y) // 8
                z = sum(_of(batch, f"b{k}", i, rows) @ theta[a : a + block] for k, a in enumerate(range(0, len(theta), block)))
                z = np.repeat(z[:, None], chains, 1).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("pack")).slice(i, 1), *[pa.array([v], pa.binary()) for v in (y, z, bytes(len(z)))]], ["pack", "y", "z", "u"])

    return table.mapInArrow(of, "pack long, y binary, z binary, u binary")


def next_scores(table: DataFrame, scores: DataFrame, steps: np.ndarray, block: int, v: np.ndarray) -> DataFrame:
    """(pack, y, z, u): z moved by steps along the last directions, u the products with the new ones, (chains, width) in a
    block.  Reads one column of features; the join's sides are bucketed alike."""
    name = f"b{block}"

    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                y = batch.column(batch.schema.get_field_index("y"))[i].as_py()
                rows = len(y) // 8
                z, u = (_of(batch, c, i, rows) for c in "zu")
                new = (z + u * steps).tobytes(), np.ascontiguousarray(_of(batch, name, i, rows) @ v.T).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("pack")).slice(i, 1), *[pa.array([c], pa.binary()) for c in (y, *new)]], ["pack", "y", "z", "u"])

    return scores.join(table.select("pack", name), "pack").mapInArrow(of, "pack long, y binary, z binary, u binary")


def losses(scores: DataFrame, at: np.ndarray) -> np.ndarray:
    """The mean log loss of each chain at positions (chains, k) along its direction: one pass over the scores."""

    def of(batches):
        out, n = np.zeros(at.shape), 0
        for batch in batches:
            for i in range(batch.num_rows):
                y = np.frombuffer(batch.column(0)[i].as_py())
                z, u = (np.frombuffer(batch.column(c)[i].as_py()).reshape(len(y), -1) for c in (1, 2))
                n += len(y)
                for k in range(at.shape[1]):
                    m = z + u * at[:, k]
                    out[:, k] += (np.logaddexp(0.0, m) - y[:, None] * m).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size + 1)), pa.array(np.append(out.ravel(), n))], ["k", "v"])

    flat = np.zeros(at.size + 1)
    for r in scores.select("y", "z", "u").mapInArrow(of, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a number for each chain and position
        flat[r.k] = r.v
    return flat[:-1].reshape(at.shape) / flat[-1]


class _End:
    """One end of a chord, |t| of it: the objective's gap is convex along the line, so chords between tried positions and
    lines through them bound the end from both sides, more narrowly with each pass."""

    def __init__(self, guess: float, most: float):
        self.known: list[tuple[float, float]] = []
        self.inside, self.outside, self.most, self.guess = 0.0, np.inf, most, guess

    def asks(self) -> np.ndarray:
        if np.isinf(self.outside):
            return self.guess * np.array(FIRST)
        # Both bounds themselves, which are near the end, and what lies between.
        return np.linspace(self.inside, self.outside, INNER + 2)[[0, *range(1, INNER), INNER + 1]]

    def told(self, ts: np.ndarray, gaps: np.ndarray) -> None:
        self.known = sorted({*self.known, *zip(ts.tolist(), gaps.tolist())})
        below, above = [k for k in self.known if k[1] <= 0] or [(0.0, 0.0)], [k for k in self.known if k[1] > 0]
        self.inside = max([self.inside, *[t for t, _ in below]])
        if not above:
            self.guess *= 4
            return
        low, high, bounds = below[-1], above[0], [above[0][0]]
        line = lambda a, b: a[0] - a[1] * (b[0] - a[0]) / (b[1] - a[1])
        self.inside = max(self.inside, min(line(low, high), high[0]))
        for a, b in ([below[-2:]] if len(below) > 1 else []) + ([above[:2]] if len(above) > 1 else []):
            if b[1] > a[1] and line(a, b) > 0:
                bounds.append(line(a, b))
        self.outside = max(min(bounds), self.inside)

    def done(self, tol: float) -> bool:
        return self.outside - self.inside <= tol * max(1e-3, self.inside) or (np.isinf(self.outside) and self.guess > self.most)


def hit_and_run(fitted: FittedSet, n_samples: int = 100, *, chains: int = 16, block: int = 16, burnin: int = 50, thin: int = 1, max_bracket: float = 1e6, tol: float = 1e-8, random_state: int | None = None, numbers: str = "random") -> DataFrame:
    """Chains that walk the exact set of a logistic model, a block of coordinates a move: chain_id, step, theta.

    Blocks take turns; a direction is drawn within the block, whitened by its part of the Hessian.  Draws have the same
    distribution as those of sample.hit_and_run with whole directions; one block of all features is that walk.  A move is
    a join without a shuffle, a write of the chains' scores, and some three passes over these for the ends of all chords,
    however many chains there are: have many chains and few draws of each.
    """
    if fitted.config.estimator != "logistic":
        raise ValueError("linear sets need no rows: sample.hit_and_run walks them by second moments")
    for name, ok in (("n_samples", n_samples >= 1), ("chains", chains >= 1), ("block", block >= 1), ("burnin", burnin >= 0), ("thin", thin >= 1), ("tol", tol > 0), ("numbers", numbers in NUMBERS)):
        if not ok:
            raise ValueError(f"{name} is out of range")
    spark, d = fitted.frame.sparkSession, fitted.d
    seed = fitted.config.random_state if random_state is None else random_state
    seed = int(np.random.SeedSequence().generate_state(1)[0]) if seed is None else int(seed)
    draws = [EvenNumbers(k, d) if numbers == "even" else np.random.default_rng([seed, k]) for k in range(chains)]
    cuts = [slice(a, min(a + block, d)) for a in range(0, d, block)]
    roots = [np.linalg.cholesky(fitted.hessian[c, c]) for c in cuts]
    theta, lam, limit = np.tile(fitted.theta, (chains, 1)), fitted.lam, fitted.l_hat + fitted.epsilon
    tables = _Bucketed(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, each = [], -(-n_samples // chains)
    with contextlib.ExitStack() as stack:
        stack.callback(lambda: [tables.drop(t) for t in list(tables.made)])
        table = tables.write(layout(fitted.frame, d, block).repartition(tables.buckets, "pack"), "packs")
        scores = tables.write(first_scores(table, fitted.theta, block, chains), "scores")
        steps = np.zeros(chains)
        for move in range(burnin + each * thin):
            cut = cuts[move % len(cuts)]
            v = np.stack([np.linalg.solve(roots[move % len(cuts)].T, r.normal(size=d)[cut]) for r in draws])
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            new = tables.write(next_scores(table, scores, steps, move % len(cuts), v), "scores")
            tables.drop(scores)
            scores = new
            bend = np.einsum("ci,ij,cj->c", v, fitted.hessian[cut, cut], v)
            ends = {(c, s): _End(float(np.sqrt(2 * fitted.epsilon / bend[c])), max_bracket) for c in range(chains) for s in (-1, 1)}
            open_ = dict(ends)
            while open_:
                most = max(len(e.asks()) for e in open_.values())
                at = np.zeros((chains, 2 * most))
                for (c, s), e in open_.items():
                    asked = e.asks()
                    at[c, (s > 0) * most : (s > 0) * most + len(asked)] = s * asked
                gaps = losses(scores, at) - limit
                own = theta[:, cut]
                whole = (theta * theta).sum(1)[:, None] + 2 * at * (own * v).sum(1)[:, None] + at * at
                gaps += lam / 2 * whole
                for (c, s), e in list(open_.items()):
                    asked = e.asks()
                    e.told(asked, gaps[c, (s > 0) * most : (s > 0) * most + len(asked)])
                    if e.done(tol):
                        open_.pop((c, s))
            for c in range(chains):
                low, high = -ends[c, -1].inside, ends[c, 1].inside
                if np.isinf(ends[c, -1].outside) or np.isinf(ends[c, 1].outside):
                    raise RuntimeError("a chord has no end; widen max_bracket")
                steps[c] = draws[c].uniform(low, high)
            theta[:, cut] += steps[:, None] * v
            if move >= burnin and (move - burnin + 1) % thin == 0:
                rows += [(c, (move - burnin) // thin, theta[c].tolist()) for c in range(chains) if (move - burnin) // thin * chains + c < n_samples]
    return spark.createDataFrame(rows, SCHEMA)
