"""What to fit and on which columns."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESTIMATORS = ("logistic", "linear")
EPSILON_MODES = ("percent_loss", "LR_alpha", "LR_alpha_highdim")
SAMPLERS = ("ellipsoid", "hitandrun")
MEASURES = ("param", "lr")
#: "sum": the fit's penalty counts once against the summed loss; "mean": against the mean loss, as the objective has it.
FIT_SCALES = ("sum", "mean")


@dataclass(frozen=True)
class SetConfig:
    """Parameters of a near-optimal set; immutable, `replace` gives changed copies."""

    estimator: str = "logistic"
    reg: str = "l2"
    C: float = 1.0
    epsilon: float = 0.02
    epsilon_mode: str = "percent_loss"
    sampler: str = "ellipsoid"
    measure: str = "lr"
    random_state: int | None = None
    max_iter: int = 1000
    tol: float = 1e-6
    safety_override: bool = False
    bootstrap_fallback: bool = True
    bootstrap_reps: int = 200
    fit_scale: str = "sum"

    def __post_init__(self):
        for name, known in (("estimator", ESTIMATORS), ("epsilon_mode", EPSILON_MODES), ("measure", MEASURES), ("fit_scale", FIT_SCALES)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if self.reg.lower() != "l2":
            raise ValueError("only the l2 penalty is supported")
        if self.sampler.lower() not in SAMPLERS:
            raise ValueError(f"sampler must be one of {', '.join(SAMPLERS)}")
        if not (self.C > 0 and math.isfinite(self.C)):
            raise ValueError("C must be finite and above 0")

    @property
    def lam(self) -> float:
        return 1.0 / self.C

    def replace(self, **changes) -> SetConfig:
        return dataclasses.replace(self, **changes)

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)


@dataclass(frozen=True)
class FeatureSpec:
    """Numeric feature columns in order, and optionally a label and a key."""

    columns: tuple[str, ...]
    label: str | None = None
    key: str | None = None

    @property
    def d(self) -> int:
        return len(self.columns)

    def project(self, df: DataFrame, with_label: bool | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """(key, x0 .. x{d-1}[, y][, *carry]) as doubles, carried columns as they are; the schema is checked before any job runs.

        Rows with a null feature or label make later aggregates fail the count check of the fit.
        """
        types = {f.name: f.dataType for f in df.schema.fields}
        wanted = [*self.columns, *([self.label] if self.label and with_label is not False else [])]
        for c in wanted:
            if c not in types:
                raise ValueError(f"no column {c}")
            if not isinstance(types[c], (T.NumericType, T.BooleanType)):
                raise ValueError(f"column {c} isn't numeric")
        if with_label and not self.label:
            raise ValueError("a label column is needed")
        key = F.col(f"`{self.key}`") if self.key else F.lit(None).cast("long")
        number = lambda c: (F.col(f"`{c}`").cast("int") if isinstance(types[c], T.BooleanType) else F.col(f"`{c}`")).cast("double")
        out = [key.alias("key"), *[number(c).alias(f"x{j}") for j, c in enumerate(self.columns)]]
        if self.label and with_label is not False:
            out.append(number(self.label).alias("y"))
        return df.select(*out, *[F.col(f"`{c}`") for c in carry])
