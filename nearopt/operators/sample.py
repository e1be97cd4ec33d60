"""Drawing parameter vectors from the set."""

from __future__ import annotations

import math
from collections.abc import Generator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.functions.even import even, even_normals
from nearopt.operators import linalg, oracle
from nearopt.operators.fit import FittedSet
from nearopt.operators.stats import matrix

#: Rows times features up to which each chain holds the rows; beyond, gaps are taken by passes over them.  The draws are
#: the same either way.
HELD = 4_000_000
SCHEMA = "chain_id int, step int, theta array<double>"
NUMBERS = ("random", "even")
#: Even numbers of a chain start this far from those of the one before.
APART = 10_007


class EvenNumbers:
    """Stands for a random generator of a chain: its n-th normals and uniforms are even numbers of its own."""

    def __init__(self, chain: int, d: int):
        self.d, self.drawn, self.moved = d, chain * APART, chain * APART

    def normal(self, size: int) -> np.ndarray:
        self.drawn += 1
        return even_normals(np.array([self.drawn]), size)[0]

    def uniform(self, low: float, high: float) -> float:
        self.moved += 1
        return low + even(np.array([self.moved]), 2 * self.d + 1)[0, -1] * (high - low)


def ellipsoid(fitted: FittedSet, n_samples: int = 100, random_state: int | None = None, mapped: str = "exact", numbers: str = "random") -> np.ndarray:
    """Uniform draws from the ellipsoid (t - theta)' H (t - theta) <= 2 epsilon, as a (k, d) array.

    mapped = "exact" solves with the transposed factor, which is what makes them uniform there; "forward" solves with
    the factor itself, for comparisons with draws made that way.  numbers = "even" takes even numbers instead of random
    ones, which other engines can repeat.
    """
    if n_samples < 1:
        raise ValueError("n_samples must be at least 1")
    if mapped not in ("exact", "forward"):
        raise ValueError("mapped must be 'exact' or 'forward'")
    if numbers not in NUMBERS:
        raise ValueError("numbers must be 'random' or 'even'")
    if numbers == "even":
        k = np.arange(1, n_samples + 1)
        g, u = even_normals(k, fitted.d), even(k, 2 * fitted.d + 1)[:, -1]
    else:
        rng = np.random.default_rng(fitted.config.random_state if random_state is None else random_state)
        g = rng.normal(size=(n_samples, fitted.d))
        u = rng.random(n_samples)
    ball = g / (np.linalg.norm(g, axis=1, keepdims=True) + 1e-18) * u[:, None] ** (1 / fitted.d) * fitted.reach
    return placed(fitted, ball, mapped)


def placed(fitted: FittedSet, ball: np.ndarray, mapped: str = "exact") -> np.ndarray:
    """Points of the ball of radius sqrt(2 epsilon) carried to the ellipsoid."""
    factor = fitted.factor.T if mapped == "exact" else fitted.factor
    return fitted.theta + np.linalg.solve(factor, ball.T).T


class _Line:
    """Gaps along theta + t v for one model family.  Scores of the current point and of the direction are kept, and
    moved with the point, so that a gap costs a pass over rows without their features."""

    def __init__(self, x, y, lam, l_hat, gram=None, cross=None, y2=None, n=0):
        self.x, self.y, self.lam, self.l_hat = x, y, lam, l_hat
        self.gram, self.cross, self.y2, self.n = gram, cross, y2, n
        self.v = self.z = None

    def gaps(self, theta: np.ndarray, v: np.ndarray, ts: list[float], step: float) -> list[float]:
        """step is how far theta moved along the last direction since then."""
        if v is not self.v:
            self._aim(theta, v, step)
        if self.gram is not None:
            return [self.c0 + t * (self.c1 + t * self.c2) for t in ts]
        return [self._gap(theta, t) for t in ts]

    def _aim(self, theta, v, step):
        if self.gram is None:
            self.z = self.x @ theta if self.z is None else self.z + step * self.zv
            self.zv = self.x @ v
        else:
            t = theta
            self.c0 = (self.y2 - 2 * t @ self.cross + t @ self.gram @ t) / (2 * self.n) + self.lam / 2 * t @ t - self.l_hat
            self.c1 = (t @ self.gram @ v - v @ self.cross) / self.n + self.lam * t @ v
            self.c2 = v @ self.gram @ v / (2 * self.n) + self.lam / 2 * v @ v
        self.v = v

    def _gap(self, theta, t):
        z, at = self.z + t * self.zv, theta + t * self.v
        return float(np.mean(np.logaddexp(0.0, z) - self.y * z)) + self.lam / 2 * float(at @ at) - self.l_hat


def _end(epsilon: float, sign: int, t_init: float, growth: float, max_bracket: float, max_bisect: int, tol: float) -> Generator[float, float, float | None]:
    """The last inside point along a direction: grow until outside, then close in by safeguarded secants.  Asks for gaps
    by yielding positions; None if max_bracket is reached inside."""
    f_in = (yield 0.0) - epsilon
    inside, outside = 0.0, t_init
    for _ in range(64):
        f_out = (yield sign * outside) - epsilon
        if f_out > 0:
            break
        inside, f_in, outside = outside, f_out, outside * growth
        if outside >= max_bracket:
            return None
    else:
        return None
    for _ in range(max_bisect):
        if outside - inside <= tol * max(1.0, outside):
            break
        middle = inside - f_in * (outside - inside) / (f_out - f_in) if f_out > f_in else (inside + outside) / 2
        width = outside - inside
        if not inside + 0.05 * width < middle < outside - 0.05 * width:
            middle = (inside + outside) / 2
        f = (yield sign * middle) - epsilon
        inside, f_in, outside, f_out = (inside, f_in, middle, f) if f > 0 else (middle, f, outside, f_out)
    return sign * inside


def _chord(epsilon: float, how: dict) -> Generator[list[float], list[float], list[float | None]]:
    """Both ends at once: yields the positions that either asks for."""
    ends = [_end(epsilon, sign, **how) for sign in (-1, 1)]
    asks, out, going = [next(e) for e in ends], [None, None], [0, 1]
    while going:
        values = yield [asks[k] for k in going]
        still = []
        for k, value in zip(going, values):
            try:
                asks[k] = ends[k].send(value)
                still.append(k)
            except StopIteration as done:
                out[k] = done.value
        going = still
    return out


def _walk(start: np.ndarray, epsilon: float, direction, n: int, burnin: int, thin: int, rng, how: dict) -> Generator[tuple, list[float], list[np.ndarray]]:
    """One chain; asks for gaps by yielding (theta, v, positions, step)."""
    theta, out, moved, tries, total, step = start.copy(), [], 0, 0, burnin + n * thin, 0.0
    while len(out) < n:
        tries += 1
        if tries > max(20 * total, total + 1):
            raise RuntimeError("the chain doesn't move; widen max_bracket or epsilon")
        v = direction(rng.normal(size=len(start)))
        size = np.linalg.norm(v)
        if size < 1e-12:
            continue
        v = v / size
        chord = _chord(epsilon, how)
        asked = next(chord)
        while True:
            gaps = yield theta, v, asked, step
            try:
                asked = chord.send(gaps)
            except StopIteration as done:
                lo, hi = done.value
                break
        step = 0.0
        if lo is None or hi is None or hi <= lo:
            continue
        step = rng.uniform(lo, hi)
        theta = theta + step * v
        moved += 1  # only moves count towards the burn-in and the thinning
        if moved > burnin and (moved - burnin) % thin == 0:
            out.append(theta.copy())
    return out


def hit_and_run(fitted: FittedSet, n_samples: int = 100, *, chains: int = 4, burnin: int = 200, thin: int = 1, directions: str | None = None, precondition: bool | None = None, t_init: float = 1.0, growth: float = 2.0, max_bracket: float = 1e6, max_bisect: int = 50, tol: float = 1e-10, random_state: int | None = None, numbers: str = "random") -> DataFrame:
    """Chains that walk the exact set along random chords: chain_id, step, theta; n_samples over all chains.

    Whitened directions are solved for exactly; precondition = True or False solves them by conjugate gradients instead,
    with or without the diagonal preconditioner.  A linear model's chords follow from second moments, so its chains need
    no rows.  A logistic model's chains each hold the rows while rows times features are at most HELD; beyond, the same
    chains advance together on the driver, and what they ask for is answered by one pass over the rows for all of them,
    some ten passes for a move.  numbers = "even" takes even numbers instead of random ones.
    """
    for name, ok in (("n_samples", n_samples >= 1), ("chains", chains >= 1), ("burnin", burnin >= 0), ("thin", thin >= 1), ("t_init", t_init > 0), ("growth", growth > 1), ("max_bracket", max_bracket > 0), ("max_bisect", max_bisect >= 1), ("tol", tol > 0)):
        if not ok:
            raise ValueError(f"{name} is out of range")
    directions = directions or ("whitened" if fitted.config.measure == "lr" else "euclidean")
    if directions not in ("whitened", "euclidean"):
        raise ValueError("directions must be 'whitened' or 'euclidean'")
    if numbers not in NUMBERS:
        raise ValueError("numbers must be 'random' or 'even'")
    seed = fitted.config.random_state if random_state is None else random_state
    seed = int(np.random.SeedSequence().generate_state(1)[0]) if seed is None else int(seed)
    spark, d = fitted.frame.sparkSession, fitted.d
    each = [n_samples // chains + (k < n_samples % chains) for k in range(chains)]
    hessian, hinv = fitted.hessian, fitted.inverse_factor.T @ fitted.inverse_factor
    how = {"t_init": t_init, "growth": growth, "max_bracket": max_bracket, "max_bisect": max_bisect, "tol": tol}
    theta, epsilon, lam, l_hat, gram, cross, y2, n = fitted.theta, fitted.epsilon, fitted.lam, fitted.l_hat, fitted.gram, fitted.cross, fitted.y2, fitted.n
    diagonal = linalg.preconditioner(np.diag(hessian)) if precondition else None

    def direction(g: np.ndarray) -> np.ndarray:
        if directions == "euclidean":
            return g
        return hinv @ g if precondition is None else linalg.conjugate_gradients(lambda v: hessian @ v, g, diagonal)

    def chain(k: int):
        rng = EvenNumbers(k, d) if numbers == "even" else np.random.default_rng([seed, k])
        return _walk(theta, epsilon, direction, each[k], burnin, thin, rng, how)

    linear = fitted.config.estimator == "linear"
    if not linear and n * d > HELD:
        return _together(fitted, [chain(k) for k in range(chains)])
    held = None
    if not linear:
        table = fitted.frame.select(*[f"x{j}" for j in range(d)], "y").toArrow()  # HELD doubles at most
        batch = table.combine_chunks().to_batches()[0]
        held = spark.sparkContext.broadcast((matrix(batch, d), batch.column(d).to_numpy(zero_copy_only=False)))

    def walk(key, frame):
        k = int(key[0])
        line = _Line(*(held.value if held is not None else (None, None)), lam, l_hat, gram, cross, y2, n)
        steps, rows = chain(k), []
        try:
            asked = next(steps)
            while True:
                asked = steps.send(line.gaps(*asked))
        except StopIteration as done:
            rows = done.value
        return pd.DataFrame({"chain_id": np.full(len(rows), k, np.int32), "step": np.arange(len(rows), dtype=np.int32), "theta": [r.tolist() for r in rows]})

    return spark.range(chains).select(F.col("id").cast("int").alias("chain_id")).repartition(chains, "chain_id").groupBy("chain_id").applyInPandas(walk, SCHEMA)


def _together(fitted: FittedSet, walks: list) -> DataFrame:
    """The same chains, whose gaps are taken by passes over the rows, one for what all of them ask."""
    out: list[list[np.ndarray]] = [[] for _ in walks]
    asked = {}

    def advance(k, value):
        try:
            asked[k] = walks[k].send(value)
        except StopIteration as done:
            out[k] = done.value
            asked.pop(k, None)

    for k in range(len(walks)):
        advance(k, None)
    while asked:
        now = dict(asked)
        batch = np.array([theta + t * v for theta, v, ts, _ in now.values() for t in ts])
        gaps = iter(oracle.loss_gap_many(fitted, batch).tolist())
        for k, (_, _, ts, _) in now.items():
            advance(k, [next(gaps) for _ in ts])
    rows = [(k, step, theta.tolist()) for k, own in enumerate(out) for step, theta in enumerate(own)]
    return fitted.frame.sparkSession.createDataFrame(rows, SCHEMA)


def sample(fitted: FittedSet, n_samples: int = 100, sampler: str | None = None, **how) -> np.ndarray:
    """(n_samples, d) draws by the sampler named, or the configured one."""
    name = (sampler or fitted.config.sampler).lower()
    if name == "ellipsoid":
        return ellipsoid(fitted, n_samples, **how)
    if name == "hitandrun":
        rows = hit_and_run(fitted, n_samples, **how).orderBy("chain_id", "step").collect()  # n_samples rows
        return np.array([r.theta for r in rows])
    raise ValueError("sampler must be 'ellipsoid' or 'hitandrun'")


def log_volume(fitted: FittedSet) -> tuple[float, int, float]:
    """(log volume of the ellipsoid, dimension, log determinant of the Hessian)."""
    ld = linalg.log_det(fitted.hessian)
    return linalg.log_ball(fitted.d) - ld / 2 + fitted.d / 2 * math.log(2 * fitted.epsilon), fitted.d, ld
