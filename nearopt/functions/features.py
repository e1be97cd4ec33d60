"""Preparing tables: cleaning, encoding, scaling, splitting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.functions.expressions import weyl
from nearopt.functions.order import quantiles, ranked

GOLDEN = 0.6180339887498949


def trimmed(df: DataFrame) -> DataFrame:
    """Every string column without white space at its ends."""
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def without_value(df: DataFrame, value: str = "?") -> DataFrame:
    """Rows in which no string column has the value."""
    hits = [F.col(f"`{c}`").eqNullSafe(value) for c, t in df.dtypes if t == "string"]
    return df.where(~reduce(lambda a, b: a | b, hits)) if hits else df


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def encoded(column: Column, positive) -> Column:
    """1.0 where the column has the positive value, else 0.0."""
    return F.when(column == F.lit(positive), 1.0).otherwise(0.0)


def by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or t.startswith("decimal")]
    return numeric, [c for c in df.columns if c not in numeric]


def imputed(df: DataFrame, means: Sequence[str] = (), constants: dict | None = None) -> DataFrame:
    """Nulls replaced by the column's mean, or by a constant."""
    if means:
        row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in means]).first()
        df = df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(row[c])) for c in means})
    return df.na.fill(constants) if constants else df


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, in one pass."""
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def standardised(df: DataFrame, columns: Sequence[str], known: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Columns less their mean, over their population standard deviation; constant ones are 0."""
    known = moments(df, columns) if known is None else known
    scaled = lambda c: (F.col(f"`{c}`").cast("double") - F.lit(known[c][0])) / F.lit(known[c][1]) if known[c][1] else F.lit(0.0)
    return df.withColumns({c: scaled(c) for c in columns})


def categories(df: DataFrame, column: str, most: int = 1000) -> list:
    """Distinct values that aren't null, sorted; more than `most` is an error."""
    rows = df.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r.v for r in rows)


def one_hot(df: DataFrame, column: str, values: Sequence | None = None, drop_if_binary: bool = False) -> DataFrame:
    """A double column `column=value` for each value; a value not among them has only zeros."""
    values = categories(df, column) if values is None else list(values)
    if drop_if_binary and len(values) == 2:
        values = values[1:]
    return df.withColumns({f"{column}={v}": F.when(F.col(f"`{column}`") == F.lit(v), 1.0).otherwise(0.0) for v in values})


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, np.ndarray]:
    """df with pc0 .. pc{k-1}, projections of the centred columns, and the explained share of the variance.

    Covariances come from one aggregate; the sign of a component is fixed by its largest weight being positive.
    """
    known = moments(df, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_samp(F.col(f"`{columns[i]}`").cast("double"), F.col(f"`{columns[j]}`").cast("double")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(columns))])
    term = lambda c, w: (F.col(f"`{c}`").cast("double") - F.lit(known[c][0])) * F.lit(float(w))
    out = {f"pc{n}": reduce(lambda a, b: a + b, [term(c, vectors[i, n]) for i, c in enumerate(columns)]) for n in range(k)}
    return df.withColumns(out), values[:k] / values.sum()


def share_of(key: Column) -> Column:
    """An even number in [0, 1) that depends on an integer key alone."""
    return weyl(key.cast("double"), GOLDEN)


def split(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the key alone, so that reruns and other partitionings agree."""
    own = share_of(F.col(f"`{key}`"))
    return df.where(own >= share), df.where(own < share)


def stratified(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """df with `test`: within each label, the share of rows that come first in an even order of their keys."""
    own = F.col(f"`{key}`")
    out = ranked(df, [label], share_of(own), [own], "_rank", "_size")
    return out.withColumn("test", F.col("_rank") <= F.floor(F.col("_size") * F.lit(share))).drop("_rank", "_size")


def stacked(first: DataFrame, *more: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), more, first)


def mixed_column(df: DataFrame, name: str, parts: dict[str, float]) -> DataFrame:
    """df with a linear combination of columns."""
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"`{c}`") for c, w in parts.items()]))


def above_median(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    median = quantiles(df, column, [0.5])[0]
    return df.withColumn(name, F.when(F.col(f"`{column}`") > F.lit(median), 1.0).otherwise(0.0))


def prevalence(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count("*").alias("n"))


def text_features(text: Column) -> dict[str, Column]:
    """length (log), share of signs that aren't ASCII letters, and share of distinct words."""
    n = F.length(text)
    words = F.split(text, " ")
    return {
        "log_length": F.log1p(n.cast("double")),
        "other_share": 1.0 - F.length(F.regexp_replace(text, "[^A-Za-z]", "")).cast("double") / F.greatest(n, F.lit(1)),
        "distinct_share": F.size(F.array_distinct(words)).cast("double") / F.size(words),
    }
