"""How far from the fitted vector the set's ellipsoid can be trusted."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.functions import expressions as E
from nearopt.operators.fit import FittedSet

#: Largest size of the third derivative of the logistic loss in the margin.
THIRD = 1 / (6 * math.sqrt(3))
SCHEMA = "third_moment double, lipschitz double, gradient_norm double, radius double, epsilon_valid double, euclidean_radius double, cubic_share double, gap_bound double"


def trust_region(fitted: FittedSet, share: float = 0.1) -> DataFrame:
    """One row: how far the quadratic model of the objective holds, from one aggregate over the rows.

    With t = |step| under the Hessian, the objective rises by at most gradient_norm t + t^2 / 2 + THIRD third_moment
    t^3 / 6, third_moment being the mean cube of the rows' norms under the inverse Hessian.  radius is the largest t whose
    cubic term stays within `share` of t^2 / 2, and epsilon_valid that t^2 / 2: up to this epsilon the ellipsoid is right
    to that share.  cubic_share and gap_bound are the cubic term's share and the whole bound at the set's own epsilon.
    lipschitz bounds the third derivative in Euclidean terms, and steps of Euclidean length up to euclidean_radius keep
    the cubic term within share of epsilon.  Linear models have no third derivative: their radii are null.
    """
    if not 0 < share < math.inf:
        raise ValueError("share must be above 0")
    xs = E.columns(fitted.d)
    margin, y = E.dot(fitted.theta), F.col("y")
    logistic = fitted.config.estimator == "logistic"
    residual = (E.sigmoid(margin) if logistic else margin) - y
    unit = E.norm(fitted.inverse_factor)
    length = F.sqrt(E.total([x * x for x in xs]))
    row = fitted.frame.agg(F.avg(unit * unit * unit), F.avg(length * length * length), *[F.avg(residual * x) for x in xs]).first()
    third = THIRD if logistic else 0.0
    gradient = np.array(row[2:]) + fitted.lam * fitted.theta
    norm, moment, lipschitz = float(np.linalg.norm(fitted.inverse_factor @ gradient)), row[0], third * row[1]
    reach = fitted.reach
    cubic = third * moment * reach**3 / 6
    radius = 3 * share / (third * moment) if third * moment > 0 else None
    euclidean = (6 * share * fitted.epsilon / lipschitz) ** (1 / 3) if lipschitz > 0 else None
    out = (moment, lipschitz, norm, radius, None if radius is None else radius**2 / 2, euclidean, cubic / fitted.epsilon if fitted.epsilon > 0 else None, norm * reach + reach**2 / 2 + cubic)
    return fitted.frame.sparkSession.createDataFrame([out], SCHEMA)
