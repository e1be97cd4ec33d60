"""Queries of what the whole set allows: bounds of reliance, Shapley values, coverings, the reach of the ellipsoid, the
likelihood ratio with many features, groups of rows, tables of models, mixing of chains and directions by Lanczos' method;
each beside the same in SQL, as in catalog."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.config import FeatureSpec, SetConfig
from nearopt.functions import features
from nearopt.functions.expressions import weyl
from nearopt.operators import blockwalk, calibrate, covering, diagnose, ensemble, groups, highdim, matrixfree, oracle, record, reliance_bounds, shapley, stats, validity
from nearopt.operators import fit as fitting
from nearopt.operators import sample as draw
from nearopt.plans import calls
from nearopt.plans import catalog as C
from nearopt.sources import tables

DELTAS = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1)
SHARE = 0.1
TAUS = (0.0, 0.5)
#: Draws and burn-in of a chain of the logistic walk; halvings with which SQL finds a chord's ends.
MOVES, BEFORE, HALVINGS = 5, 3, 44
#: Features of the wide table: powers of discount, tax and line number beside the quantity.
_POWERS = [(a, b, c) for a in range(3) for b in range(3) for c in range(2)] + [(3, 0, 0), (0, 3, 0)]
WIDE = len(_POWERS)
ROOTED = ((1.0, -2.0), (0.5, 1.0), (0.0, 3.0))
#: Angles at which SQL looks for the extremes on an ellipse.
ANGLES = 200_000
LINE = FeatureSpec(("l_quantity", "l_discount", "l_tax", "l_linenumber"), "price", "l_orderkey")
LINE_BATCH = ((2.0, 0.1, -0.1, 0.05), (1.5, -0.4, 0.3, 0.2), (0.5, 0.0, 1.0, -0.7))


def lines(s, f) -> DataFrame:
    """Line items: four standardised features, the price in ten thousands."""
    rows = tables.table(s, f, "lineitem").select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in LINE.columns], (F.col("l_extendedprice") / 10000.0).alias("price"))
    return features.standardised(rows, list(LINE.columns))


def line_set(s, f) -> fitting.FittedSet:
    return fitting.at(LINE.project(lines(s, f), True), LINE, SetConfig(estimator="linear"), LINE_BATCH[0])


def _bounds(s, f) -> DataFrame:
    out = reliance_bounds.bounds(C.part_set(s, f), C.part(s, f), C.REPS, order=C.even_order("p_partkey"))
    return C.rounded(out.select("j", "feature", "reliance_min", "reliance_max"))


def _logistic_bounds(s, f) -> DataFrame:
    out = reliance_bounds.bounds(C.document_set(s, f), C.documents(s, f), C.REPS, starts=C.BATCH, order=C.even_order("doc_id"))
    return C.rounded(out.select("j", "feature", "reliance_min", "reliance_max"), 4)


def _shapley_documents(s, f) -> DataFrame:
    return C.rounded(shapley.shapley(C.document_set(s, f), C.documents(s, f), C.BATCH))


def _shapley_lines(s, f) -> DataFrame:
    return C.rounded(shapley.shapley(line_set(s, f), lines(s, f), LINE_BATCH))


def _shapley_cloud(s, f) -> DataFrame:
    p = C.part_set(s, f)
    return C.rounded(shapley.summary(shapley.shapley(p, C.part(s, f), C.draws(p)), C.PART))


def _covering(s, f) -> DataFrame:
    p = C.document_set(s, f)
    return C.rounded(covering.capacity(p, C.documents(s, f), C.draws(p), DELTAS))


def _traversal(s, f) -> DataFrame:
    p = C.document_set(s, f)
    return C.rounded(covering.traversal(p, C.documents(s, f), C.draws(p)))


def _row_capacity(s, f) -> DataFrame:
    return C.rounded(covering.row_capacity(C.document_set(s, f), C.documents(s, f), ("lang",)).withColumnRenamed("key", "doc_id"))


def _highdim(s, f) -> DataFrame:
    p = C._flagship_set(s, f)
    found = highdim.correction(p)
    p = calibrate.calibrated(fitting.replace(p, config=p.config.replace(epsilon_mode="LR_alpha_highdim", epsilon=0.05)))
    return C.one_row(s, kappa=found["kappa"], spread=found["spread"], gamma=round(found["gamma"], 4), factor=found["factor"], epsilon=p.epsilon, calibration=p.calibration)


def _group_counts(s, f) -> DataFrame:
    p = C.document_set(s, f)
    return groups.counts(p, C.documents(s, f), "source", C.draws(p), TAUS)


def _gap_ranges(s, f) -> DataFrame:
    p = C.document_set(s, f)
    out = groups.gap_ranges(p, C.documents(s, f), "lang", C.draws(p), TAUS)
    return C.rounded(out.select("tau", "metric", "gap_min", "gap_max"))


def _group_gaps(s, f) -> DataFrame:
    p = C.document_set(s, f)
    return C.rounded(groups.gaps(groups.counts(p, C.documents(s, f), "lang", C.BATCH, (0.0,))))


def models(s, f) -> DataFrame:
    """A model for each size of parts."""
    size = F.col("p_size").cast("double")
    theta = F.array(0.05 + 0.1 * weyl(size, C.STEPS[0]), -0.03 + 0.06 * weyl(size, C.STEPS[1]))
    return tables.table(s, f, "part").select(F.col("p_size").cast("long").alias("model_id"), theta.alias("theta")).distinct()


def _ensemble(s, f) -> ensemble.EnsembleSet:
    return ensemble.from_ensemble(models(s, f), C.part(s, f), C.PART, SetConfig(estimator="linear", epsilon=0.01))


def _ensemble_reliance(s, f) -> DataFrame:
    return C.rounded(_ensemble(s, f).reliance(C.part(s, f), C.REPS, order=C.even_order("p_partkey")))


def _mixing(s, f) -> DataFrame:
    """The draws as four chains of fifteen, taken in half a minute."""
    rows = oracle.samples_frame(s, C.draws(C.document_set(s, f))).select(F.floor(F.col("sample_id") / 15).cast("int").alias("chain_id"), (F.col("sample_id") % 15).alias("step"), "theta")
    return C.rounded(diagnose.mixing(rows, 30.0))


def _trust(s, f) -> DataFrame:
    p = C.document_set(s, f)
    return C.one_row(s, trust_fraction=diagnose.trust_fraction(p, C.draws(p), SHARE))


def _record(s, f) -> DataFrame:
    row = record.recorded_fit(C.part(s, f), C.PART, SetConfig(estimator="linear", epsilon=C.RHO, random_state=11))[1]
    return C.rounded(row.drop("seconds", "spark", "python", "numpy", "arrow", "blas"))


def _logistic_walk(s, f) -> DataFrame:
    """Chains through the exact set of a logistic model, by even numbers."""
    rows = draw.hit_and_run(C.document_set(s, f), 2 * MOVES, chains=2, burnin=BEFORE, numbers="even")
    return C.rounded(rows.select("chain_id", "step", F.element_at("theta", 1).alias("a0"), F.element_at("theta", 2).alias("a1")))


def _block_walk(s, f) -> DataFrame:
    """The same set, a coordinate a move, with scores kept in tables."""
    rows = blockwalk.hit_and_run(C.document_set(s, f), 2 * MOVES, chains=2, block=1, burnin=BEFORE, numbers="even")
    return C.rounded(rows.select("chain_id", "step", F.element_at("theta", 1).alias("a0"), F.element_at("theta", 2).alias("a1")))


def _wide(s, f) -> DataFrame:
    """Second moments of more features than are written out as columns: powers and products of line items' columns."""
    rows = tables.table(s, f, "lineitem").select(*[c.alias(f"w{k}") for k, c in enumerate(_wide_columns())])
    spec = FeatureSpec(tuple(f"w{k}" for k in range(WIDE)))
    out = stats.sums(spec.project(rows, False).withColumn("y", F.lit(1.0)), WIDE, "linear", [0.0] * WIDE)
    return C.grid(s, out.second / out.n, "value")


def _wide_columns() -> list:
    q, d, t, n = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))
    return [q / 50 * F.pow(d * 10, F.lit(float(a))) * F.pow(t * 10, F.lit(float(b))) * F.pow(n / 7, F.lit(float(c))) for a, b, c in _POWERS]


def _root(s, f) -> DataFrame:
    out = matrixfree.inverse_root(C.documents(s, f), C.DOCS, SetConfig(), C.THETA, ROOTED)
    return C.rounded(s.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(out)], "i int, r0 double, r1 double"))


_r = C._r
_J = "CASE j WHEN 0 THEN 'x0' ELSE 'x1' END AS feature"


def _sql_validity() -> str:
    k, lam = f"{validity.THIRD!r}e0", C.LAM
    return f"""WITH {C.SET}, m AS (SELECT avg(unit * unit * unit) AS third_moment, {k} * avg(pow(x0 * x0 + x1 * x1, 1.5e0)) AS lipschitz, avg((p - y) * x0) + {lam} * ({C.THETA[0]}e0) AS g0, avg((p - y) * x1) + {lam} * ({C.THETA[1]}e0) AS g1 FROM s),
n AS (SELECT *, sqrt((g0 * g0 * h11 - 2 * g0 * g1 * h01 + g1 * g1 * h00) / det) AS gradient_norm, 3 * {SHARE}e0 / ({k} * third_moment) AS radius, {k} * third_moment * pow(2 * eps, 1.5e0) / 6 AS cubic FROM m, h)
SELECT {_r('third_moment')}, {_r('lipschitz')}, {_r('gradient_norm')}, {_r('radius')}, {_r('epsilon_valid', 'radius * radius / 2')}, {_r('euclidean_radius', f'pow(6 * {SHARE}e0 * eps / lipschitz, 1 / 3.0e0)')}, {_r('cubic_share', 'cubic / eps')}, {_r('gap_bound', 'gradient_norm * sqrt(2 * eps) + eps + cubic')} FROM n"""


_WALK = f"""WITH RECURSIVE {C.DOC_DRAWS}, lab AS (SELECT sample_id, doc_id, a0 * x0 + a1 * x1 >= 0 AS one FROM z, drawn),
dist AS MATERIALIZED (SELECT p.sample_id AS a, q.sample_id AS b, count(*) FILTER (p.one <> q.one) AS c FROM lab p JOIN lab q USING (doc_id) GROUP BY p.sample_id, q.sample_id),
walk(k, taken, centres, far, radius) AS (SELECT 1, 0, [0], (SELECT b FROM dist WHERE a = 0 ORDER BY c DESC, b LIMIT 1), (SELECT max(c) FROM dist WHERE a = 0)
UNION ALL SELECT k + 1, far, list_append(centres, far), arg_max(b, (near, -b)), max(near) FROM (SELECT k, centres, far, b, min(c) AS near FROM walk JOIN dist ON list_contains(list_append(centres, far), a) WHERE radius > 0 GROUP BY k, centres, far, b) GROUP BY k, centres, far)"""
_COVERING = f"""{_WALK}, deltas(delta) AS (VALUES {", ".join(f"({d}e0)" for d in DELTAS)}), first AS (SELECT delta, min(k) AS k FROM deltas, walk, h WHERE radius <= delta * n GROUP BY delta)
SELECT delta, k AS covering_number, round(radius / n, 6) + 0.0e0 AS radius, round(log2(k), 6) + 0.0e0 AS capacity FROM first JOIN walk USING (k), h"""


def _sql_row_capacity() -> str:
    h = lambda p: f"(CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0 END + CASE WHEN {p} < 1 THEN -(1 - {p}) * log2(1 - {p}) ELSE 0 END)"
    return f"""WITH {C.SET}, ends AS (SELECT doc_id, lang, 1 / (1 + exp(-lo)) AS a, 1 / (1 + exp(-hi)) AS b FROM s), e AS (SELECT *, {h('a')} AS ha, {h('b')} AS hb FROM ends)
SELECT doc_id, {_r('p_lo', 'a')}, {_r('p_hi', 'b')}, round(CASE WHEN b - a > 1e-9 THEN greatest((a * hb - b * ha) / (b - a) + log2(1 + pow(2.0e0, (ha - hb) / (b - a))), 0) ELSE 0 END, 6) + 0.0e0 AS capacity, lang FROM e"""


def _sql_shapley(d: int, value: str, prefix: str) -> str:
    """Shapley values by all coalitions s (bits) of rows z x batch; value is the score's aggregate of label y and margin m."""
    margin = " + ".join(f"a{j} * CASE WHEN (s >> {j}) & 1 = 1 THEN x{j} ELSE m{j} END" for j in range(d))
    means = ", ".join(f"avg(x{j}) AS m{j}" for j in range(d))
    weight = " ".join(f"WHEN {s} THEN {math.factorial(s) * math.factorial(d - 1 - s)}.0e0 / {math.factorial(d)}" for s in range(d))
    return f"""{prefix}, mean AS (SELECT {means}, var_pop(y) AS var FROM z), coalition AS (SELECT sample_id, s, {value} AS v FROM (SELECT sample_id, s, y, var, {margin} AS m FROM z, mean, batch, (SELECT CAST(range AS INTEGER) AS s FROM range(0, {1 << d}))) GROUP BY sample_id, s),
shares AS (SELECT w.sample_id, j, sum((w.v - o.v) * CASE bit_count(o.s) {weight} END) AS value FROM (SELECT CAST(range AS INTEGER) AS j FROM range(0, {d})), coalition o, coalition w WHERE (o.s >> j) & 1 = 0 AND w.s = o.s + (1 << j) AND w.sample_id = o.sample_id GROUP BY w.sample_id, j)"""


_LOGLIK, _R2 = "avg(y * m - greatest(m, 0) - ln(1 + exp(-abs(m))))", "1 - avg((y - m) * (y - m)) / any_value(var)"
_LINES = "lm AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS a{j}, stddev_pop(CAST({c} AS DOUBLE)) AS s{j}" for j, c in enumerate(LINE.columns)) + " FROM lineitem), z AS (SELECT " + ", ".join(f"({c} - a{j}) / s{j} AS x{j}" for j, c in enumerate(LINE.columns)) + ", l_extendedprice / 10000.0e0 AS y FROM lineitem, lm), batch(sample_id, a0, a1, a2, a3) AS (VALUES " + ", ".join(f"({i}, {', '.join(f'{v}e0' for v in row)})" for i, row in enumerate(LINE_BATCH)) + ")"


def _sql_bounds() -> str:
    moved = C._mcr("iid")
    assert moved.startswith(C.PZ)
    return f"""WITH {C.PSET}{moved[len(C.PZ):]}, moved AS (SELECT j, avg(xp * other) AS mo, avg(xp * y) AS ml FROM met GROUP BY j),
form AS (SELECT j, (mo - g01 / n) / v AS a, (ml - CASE j WHEN 0 THEN c0 ELSE c1 END / n) / v AS b, h.* FROM moved, h, (SELECT v FROM total)),
edge AS (SELECT j, a, b, t0 + (r * cos(w) - h01 / sqrt(h00) * (r * sin(w) / sqrt(h11 - h01 * h01 / h00))) / sqrt(h00) AS e0, t1 + r * sin(w) / sqrt(h11 - h01 * h01 / h00) AS e1 FROM (SELECT *, sqrt(2 * eps) AS r FROM form), (SELECT 2 * pi() * range / {ANGLES}.0e0 AS w FROM range(0, {ANGLES}))),
val AS (SELECT j, 2 * a * e0 * e1 - 2 * b * CASE j WHEN 0 THEN e0 ELSE e1 END AS v FROM edge)
SELECT j, {_J}, {_r('reliance_min', 'min(v)')}, {_r('reliance_max', 'max(v)')} FROM val GROUP BY j"""


def _sql_counts(by: str, drawn: str, taus) -> str:
    return f"""{drawn}, taus(tau) AS (VALUES {", ".join(f"({t}e0)" for t in taus)}), counted AS (SELECT {by} AS "group", tau, sample_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (a0 * x0 + a1 * x1 >= tau) AS selected, count(*) FILTER (a0 * x0 + a1 * x1 >= tau AND y = 1) AS true_positives FROM z, drawn, taus GROUP BY {by}, tau, sample_id)"""


_GAPS = """, rated AS (SELECT tau, sample_id, "group", unnest(['selection_rate', 'true_positive_rate', 'false_positive_rate', 'accuracy']) AS metric, unnest([selected / n, CASE WHEN positives > 0 THEN true_positives / positives END, CASE WHEN n > positives THEN (selected - true_positives) / (n - positives) END, (2 * true_positives + n - positives - selected) / n]) AS rate FROM counted),
gaps AS (SELECT tau, sample_id, metric, max(rate) - min(rate) AS gap, first("group" ORDER BY rate, "group" NULLS LAST) AS low_group, first("group" ORDER BY rate DESC, "group" NULLS LAST) AS high_group FROM rated WHERE rate IS NOT NULL GROUP BY tau, sample_id, metric)"""
_SIZES = f"""batch AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS model_id, 0.05e0 + 0.1e0 * (p_size * {C.STEPS[0]}e0 - floor(p_size * {C.STEPS[0]}e0)) AS a0, -0.03e0 + 0.06e0 * (p_size * {C.STEPS[1]}e0 - floor(p_size * {C.STEPS[1]}e0)) AS a1 FROM part)"""
_MODELS = f"""{_SIZES}, o AS (SELECT model_id, a0, a1, avg((y - a0 * x0 - a1 * x1) * (y - a0 * x0 - a1 * x1)) / 2 + (a0 * a0 + a1 * a1) / 2 AS objective FROM z, batch GROUP BY model_id, a0, a1), gap AS (SELECT *, objective - min(objective) OVER () AS loss_gap, 0.01e0 * min(objective) OVER () AS eps FROM o), inside AS (SELECT * FROM gap WHERE loss_gap <= eps + 1e-12)"""


def _sql_ensemble_reliance() -> str:
    text = C._mcr("iid")
    start, end = text.index("batch(sample_id"), text.index("wide AS (")
    text = text[:start] + _MODELS + ", members AS (SELECT model_id AS sample_id, a0, a1 FROM inside),\n" + text[end:]
    return f"WITH {text.replace('FROM met, batch', 'FROM met, members').replace('FROM z, batch, total', 'FROM z, members, total')} SELECT sample_id AS model_id, j, {_r('base')}, {_r('permuted')}, {_r('importance')} FROM mcr"


def _sql_mixing() -> str:
    return f"""WITH {C.DOC_DRAWS}, v AS (SELECT sample_id // 15 AS c, sample_id % 15 AS s, 0 AS j, a0 AS v FROM drawn UNION ALL SELECT sample_id // 15, sample_id % 15, 1, a1 FROM drawn),
halves AS (SELECT j, 2 * c + CASE WHEN s < 7 THEN 0 ELSE 1 END AS h, CASE WHEN s < 7 THEN s ELSE s - 8 END AS t, v FROM v WHERE s <> 7), cen AS (SELECT *, avg(v) OVER (PARTITION BY j, h) AS mu FROM halves),
cov AS (SELECT a.j, a.h, b.t - a.t AS lag, sum((a.v - a.mu) * (b.v - b.mu)) / 7 AS g FROM cen a JOIN cen b ON a.j = b.j AND a.h = b.h AND b.t >= a.t GROUP BY a.j, a.h, b.t - a.t),
w AS (SELECT j, avg(g) * 7 / 6 AS within FROM cov WHERE lag = 0 GROUP BY j), bm AS (SELECT j, var_samp(mu) AS b FROM (SELECT DISTINCT j, h, mu FROM cen) GROUP BY j),
wb AS (SELECT j, within, within * 6 / 7 + b AS total FROM w JOIN bm USING (j)), rho AS (SELECT j, lag, CASE WHEN lag = 0 THEN 1 ELSE 1 - (any_value(within) - avg(g)) / any_value(total) END AS rho FROM cov JOIN wb USING (j) GROUP BY j, lag),
pairs AS (SELECT j, lag // 2 AS p, sum(rho) AS s FROM rho WHERE lag < 6 GROUP BY j, lag // 2), cut AS (SELECT *, min(CASE WHEN s <= 0 THEN p END) OVER (PARTITION BY j) AS stop FROM pairs),
mono AS (SELECT j, min(s) OVER (PARTITION BY j ORDER BY p) AS s FROM cut WHERE stop IS NULL OR p < stop), tau AS (SELECT j, -1 + 2 * sum(s) AS tau FROM mono GROUP BY j),
e AS (SELECT j, sqrt(total / within) AS rhat, 56 / greatest(coalesce(tau, -1), 1 / log10(56)) AS ess FROM wb LEFT JOIN tau USING (j))
SELECT j, 4 AS chains, 60 AS draws, {_r('rhat')}, {_r('ess')}, {_r('ess_per_minute', '2 * ess')} FROM e"""


def _sql_logistic_walk(blocks: bool = False) -> str:
    """The moves of the logistic walk: each is HALVINGS steps in which both ends of a chord close in, then the draw; with
    blocks, along one coordinate after the other."""
    ends = {"p": "(pin + pout) / 2", "m": "-(nin + nout) / 2"}
    margin = lambda t: f"((a0 + {t} * v0) * x0 + (a1 + {t} * v1) * x1)"
    loss = {k: f"avg(greatest({margin(t)}, 0) + ln(1 + exp(-abs({margin(t)}))) - y * {margin(t)})" for k, t in ends.items()}
    over = {k: f"l{k} + 0.5e0 * {C.LAM} * ((a0 + {t} * v0) * (a0 + {t} * v0) + (a1 + {t} * v1) * (a1 + {t} * v1)) - l_hat - eps > 0" for k, t in ends.items()}
    along = lambda at, it: [f"CASE WHEN {it} % 2 = {j} THEN {calls._normal(at, j)} ELSE 0 END" for j in range(2)]
    whole = lambda at, it: [f"h11 * ({calls._normal(at, 0)}) - h01 * ({calls._normal(at, 1)})", f"h00 * ({calls._normal(at, 1)}) - h01 * ({calls._normal(at, 0)})"]
    turn = along if blocks else whole
    now, new = f"(chain_id * {draw.APART} + it + 1)", f"(chain_id * {draw.APART} + it + 2)"
    last = f"k = {HALVINGS - 1}"
    unit = lambda w: f"{w} / sqrt(w0 * w0 + w1 * w1)"
    return f"""WITH RECURSIVE {C.SET}, walk(chain_id, it, k, a0, a1, v0, v1, pin, pout, nin, nout) AS (
SELECT chain_id, 0, 0, {C.THETA[0]}e0, {C.THETA[1]}e0, {unit('w0')}, {unit('w1')}, 0.0e0, 4.0e0, 0.0e0, 4.0e0 FROM (SELECT chain_id, {turn(now, 'it')[0]} AS w0, {turn(now, 'it')[1]} AS w1 FROM (SELECT CAST(range AS INTEGER) AS chain_id, 0 AS it FROM range(0, 2)), h)
UNION ALL SELECT chain_id, CASE WHEN {last} THEN it + 1 ELSE it END, CASE WHEN {last} THEN 0 ELSE k + 1 END, CASE WHEN {last} THEN a0 + (u * (p1 + n1) - n1) * v0 ELSE a0 END, CASE WHEN {last} THEN a1 + (u * (p1 + n1) - n1) * v1 ELSE a1 END,
CASE WHEN {last} THEN {unit('w0')} ELSE v0 END, CASE WHEN {last} THEN {unit('w1')} ELSE v1 END, CASE WHEN {last} THEN 0.0e0 ELSE p1 END, CASE WHEN {last} THEN 4.0e0 ELSE p2 END, CASE WHEN {last} THEN 0.0e0 ELSE n1 END, CASE WHEN {last} THEN 4.0e0 ELSE n2 END FROM (
SELECT q.*, CASE WHEN {over['p']} THEN pin ELSE (pin + pout) / 2 END AS p1, CASE WHEN {over['p']} THEN (pin + pout) / 2 ELSE pout END AS p2, CASE WHEN {over['m']} THEN nin ELSE (nin + nout) / 2 END AS n1, CASE WHEN {over['m']} THEN (nin + nout) / 2 ELSE nout END AS n2, {calls._even(now, 4)} AS u, {turn(new, '(it + 1)')[0]} AS w0, {turn(new, '(it + 1)')[1]} AS w1 FROM (
SELECT chain_id, it, k, a0, a1, v0, v1, pin, pout, nin, nout, {loss['p']} AS lp, {loss['m']} AS lm FROM walk, z WHERE it < {BEFORE + MOVES} GROUP BY chain_id, it, k, a0, a1, v0, v1, pin, pout, nin, nout) q, h))
SELECT chain_id, CAST(it - {BEFORE + 1} AS INTEGER) AS step, {_r('a0')}, {_r('a1')} FROM walk WHERE it > {BEFORE} AND k = 0"""


def _sql_wide() -> str:
    value = ", ".join(f"CAST(l_quantity AS DOUBLE) / 50 * pow(l_discount * 10.0e0, {a}) * pow(l_tax * 10.0e0, {b}) * pow(l_linenumber / 7.0e0, {c})" for a, b, c in _POWERS)
    pairs = f"SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j FROM range(0, {WIDE}) a, range(0, {WIDE}) b"
    return f"WITH w AS (SELECT [{value}] AS x FROM lineitem) SELECT i, j, round(avg(x[i + 1] * x[j + 1]), 6) + 0.0e0 AS value FROM w, ({pairs}) GROUP BY i, j"


_DOC_BATCH = f"WITH {C.Z}, batch(sample_id, a0, a1) AS (VALUES {C._values(C.BATCH)})"
_PART_DRAWN = f"WITH {C.PART_DRAWS}, batch AS (SELECT sample_id, a0, a1 FROM drawn)"
_SPREAD = f"WITH {C.SET}, l AS (SELECT margin + (p - y) * unit * unit / n / (1 - p * (1 - p) * unit * unit / n) AS m FROM s) SELECT round(var_pop(m), 6) + 0.0e0 AS spread FROM l"
_SHARES = f"SELECT sample_id, j, {_r('value')}, 0.0e0 AS std_error FROM shares"

QUERIES: dict[str, tuple[Callable, str | None]] = {
    "reliance_bounds_part": (_bounds, _sql_bounds()),
    "reliance_bounds_documents": (_logistic_bounds, None),
    "shapley_documents": (_shapley_documents, f"{_sql_shapley(2, _LOGLIK, _DOC_BATCH)} {_SHARES}"),
    "shapley_lineitem": (_shapley_lines, f"{_sql_shapley(4, _R2, 'WITH ' + _LINES)} {_SHARES}"),
    "shapley_cloud_part": (_shapley_cloud, f"{_sql_shapley(2, _R2, _PART_DRAWN)} SELECT j, {_J}, {_r('value_mean', 'avg(value)')}, {_r('value_std', 'stddev_pop(value)')}, {_r('value_min', 'min(value)')}, {_r('value_max', 'max(value)')}, 0.0e0 AS std_error FROM shares GROUP BY j"),
    "covering_documents": (_covering, _COVERING),
    "covering_order": (_traversal, f"{_WALK} SELECT k, taken AS sample_id, round(radius / n, 6) + 0.0e0 AS radius FROM walk, h"),
    "row_capacity_documents": (_row_capacity, _sql_row_capacity()),
    "validity_documents": (lambda s, f: C.rounded(validity.trust_region(C.document_set(s, f), SHARE)), _sql_validity()),
    "unseen_spread_documents": (lambda s, f: C.one_row(s, spread=highdim.unseen_spread(C.document_set(s, f))), _SPREAD),
    "highdim_epsilon": (_highdim, None),
    "group_counts": (_group_counts, f"{_sql_counts('source', 'WITH ' + C.DOC_DRAWS, TAUS)} SELECT * FROM counted"),
    "group_gaps": (_group_gaps, f"{_sql_counts('lang', f'WITH {C.Z}, drawn(sample_id, a0, a1) AS (VALUES {C._values(C.BATCH)})', (0.0,))}{_GAPS} SELECT tau, sample_id, metric, {_r('gap')}, low_group, high_group FROM gaps"),
    "group_gap_ranges": (_gap_ranges, f"{_sql_counts('lang', 'WITH ' + C.DOC_DRAWS, TAUS)}{_GAPS} SELECT tau, metric, {_r('gap_min', 'min(gap)')}, {_r('gap_max', 'max(gap)')} FROM gaps GROUP BY tau, metric"),
    "ensemble_membership": (lambda s, f: C.rounded(_ensemble(s, f).membership()), f"WITH {C.PZ}, {_MODELS} SELECT model_id, {_r('objective')}, {_r('loss_gap')}, loss_gap <= eps + 1e-12 AS inside FROM gap"),
    "ensemble_intervals": (lambda s, f: C.rounded(_ensemble(s, f).intervals()), f"WITH {C.PZ}, {_MODELS}, c AS (SELECT 0 AS j, 'x0' AS feature, a0 AS v FROM inside UNION ALL SELECT 1, 'x1', a1 FROM inside) SELECT j, feature, {_r('lo', 'min(v)')}, {_r('hi', 'max(v)')}, {_r('mean', 'avg(v)')}, {_r('std', 'stddev_pop(v)')}, min(v) > 0 OR max(v) < 0 AS certain FROM c GROUP BY j, feature"),
    "ensemble_bands": (lambda s, f: C.rounded(_ensemble(s, f).bands(C.part(s, f)).withColumnRenamed("key", "p_partkey")), f"WITH {C.PZ}, {_MODELS} SELECT p_partkey, round(min(a0 * x0 + a1 * x1), 6) + 0.0e0 AS lo, round(max(a0 * x0 + a1 * x1), 6) + 0.0e0 AS hi FROM z, inside GROUP BY p_partkey"),
    "ensemble_ambiguity": (lambda s, f: C.rounded(_ensemble(s, f).ambiguity(C.part(s, f), 0.01)), f"WITH {C.PZ}, {_MODELS}, b AS (SELECT p_partkey, min(a0 * x0 + a1 * x1) < 0.01e0 AND max(a0 * x0 + a1 * x1) >= 0.01e0 AS hit FROM z, inside GROUP BY p_partkey) SELECT round(avg(CAST(hit AS DOUBLE)), 6) + 0.0e0 AS ambiguity_rate, CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS n_ambiguous, 0.01e0 AS threshold FROM b"),
    "ensemble_reliance": (_ensemble_reliance, _sql_ensemble_reliance()),
    "chain_mixing": (_mixing, _sql_mixing()),
    "trust_fraction": (_trust, f"WITH {C.DOC_DRAWS}, t AS (SELECT 3 * {SHARE}e0 / ({validity.THIRD!r}e0 * avg(unit * unit * unit)) AS radius FROM s) SELECT round(avg(CASE WHEN sqrt(2 * eps) * r <= radius THEN 1.0e0 ELSE 0.0e0 END), 6) + 0.0e0 AS trust_fraction FROM disc, t, h"),
    "run_record": (_record, f"WITH {C.PSET} SELECT 'linear' AS estimator, 2 AS d, any_value(n) AS n, 11 AS seed, CAST(1 AS INTEGER) AS passes, any_value(n) AS rows_read, {_r('label_min', 'min(y)')}, {_r('label_max', 'max(y)')}, {_r('label_sum', 'sum(y)')}, round(any_value(((h00 + h11) / 2 + sqrt((h00 - h11) * (h00 - h11) / 4 + h01 * h01)) / ((h00 + h11) / 2 - sqrt((h00 - h11) * (h00 - h11) / 4 + h01 * h01))), 6) + 0.0e0 AS kappa, round(any_value(eps), 6) + 0.0e0 AS epsilon, 'percent_loss' AS calibration FROM z, h"),
    "hit_and_run_logistic": (_logistic_walk, _sql_logistic_walk()),
    "hit_and_run_blocks": (_block_walk, _sql_logistic_walk(True)),
    "gram_wide": (_wide, _sql_wide()),
    "inverse_root": (_root, f"WITH {C.SET}, v(i, v0, v1) AS (VALUES {C._values(ROOTED)}), a AS (SELECT *, 1 / sqrt(det) AS q, sqrt((h00 + h11) / det + 2 / sqrt(det)) AS t FROM h) SELECT i, round(((h11 / det + q) * v0 - h01 / det * v1) / t, 6) + 0.0e0 AS r0, round((-h01 / det * v0 + (h00 / det + q) * v1) / t, 6) + 0.0e0 AS r1 FROM a, v"),
}
