"""Reading tables, making synthetic ones, and writing results."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearopt.functions import expressions as E
from nearopt.functions import features
from nearopt.functions.even import even_steps

#: Columns of the census income file, which has no header; their order is fixed by the file.
INCOME = "age double, workclass string, fnlwgt double, education string, education_num double, marital_status string, occupation string, relationship string, race string, sex string, capital_gain double, capital_loss double, hours_per_week double, native_country string, income string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str, name: str) -> tuple:
    """(path, bytes, time of change) of a staged table's files, in the order of their names, from whatever store it is in."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))


def csv(spark: SparkSession, path: str, schema: str, missing: str = "?", most: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """A file without header: cells trimmed, blank rows and rows with a missing cell dropped, then at most some rows."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    raw = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in names), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = features.without_value(features.trimmed(raw).na.drop("all"), missing)
    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields])
    return features.first_rows(rows, most, *(order or names)) if most else rows


def income(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The census income file, with label 1.0 above 50K."""
    return csv(spark, path, INCOME, most=most).withColumn("label", features.encoded(F.col("income"), ">50K"))


def from_arrays(spark: SparkSession, x, y) -> DataFrame:
    """(row_id, x0 .., y) of matrices in memory; shapes are checked."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim != 2:
        raise ValueError("X must have two dimensions")
    if y.shape != (len(x),):
        raise ValueError("y must have as many values as X has rows")
    names = [f"x{j}" for j in range(x.shape[1])]
    schema = ", ".join(["row_id long", *[f"{c} double" for c in names], "y double"])
    return spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))], schema)


def _numbers(seed: int, numbers: str):
    """unit(i) and normal(i), the i-th of each row's numbers in (0, 1) and of its normals; even ones any engine can repeat."""
    if numbers == "even":
        steps = even_steps(200)
        unit = lambda i: E.weyl((F.col("row_id") + 1).cast("double"), float(steps[i]))
    else:
        unit = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "row_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return unit, lambda i: F.sqrt(-2.0 * F.log(unit(2 * i))) * F.cos(2 * math.pi * unit(2 * i + 1))


def _rows(spark: SparkSession, n: int, partitions: int | None, over: DataFrame | None = None) -> DataFrame:
    if over is not None:
        return over.select(F.col(f"`{over.columns[0]}`").cast("long").alias("row_id"))
    return spark.range(0, n, 1, partitions or max(1, n // 1_000_000)).withColumnRenamed("id", "row_id")


def synthetic(spark: SparkSession, n: int, weights, kind: str = "logistic", seed: int = 0, noise: float = 0.1, partitions: int | None = None, numbers: str = "random", over: DataFrame | None = None) -> DataFrame:
    """(row_id, x0 .., y): normal features, labels of a logistic or linear model.

    Each value is a function of the row's number and the seed, so any partitioning gives the same rows.  over, if given,
    is a table whose first column has the numbers: each of its rows gets features and a label, and n isn't used.
    """
    unit, normal = _numbers(seed, numbers)
    d = len(weights)
    rows = _rows(spark, n, partitions, over).withColumns({f"x{j}": normal(j) for j in range(d)})
    m = E.dot(weights)
    y = (unit(2 * d) < E.sigmoid(m)).cast("double") if kind == "logistic" else m + noise * normal(d)
    return rows.withColumn("y", y)


def classification(spark: SparkSession, n: int, columns: int = 10, informative: int = 6, redundant: int = 2, separation: float = 1.0, seed: int = 0, partitions: int | None = None, numbers: str = "random", over: DataFrame | None = None) -> DataFrame:
    """(row_id, x0 .., y): two classes of even chance.  The first columns are informative, normal around separation on
    one side or the other by class and column; redundant ones are fixed mixtures of these; the rest is noise.  over is as
    in synthetic()."""
    if not 0 < informative <= informative + redundant <= columns:
        raise ValueError("informative and redundant columns must fit into the columns")
    unit, normal = _numbers(seed, numbers)
    rows = _rows(spark, n, partitions, over).withColumn("y", (unit(2 * columns) < 0.5).cast("double"))
    side = lambda j: (2 * F.col("y") - 1) * separation * (1 if j % 2 == 0 else -1)
    rows = rows.withColumns({f"x{j}": normal(j) + side(j) for j in range(informative)})
    weight = lambda r, i: 2 * ((r * informative + i + 1) * features.GOLDEN % 1) - 1
    rows = rows.withColumns({f"x{informative + r}": E.total([weight(r, i) * F.col(f"x{i}") for i in range(informative)]) for r in range(redundant)})
    rows = rows.withColumns({f"x{j}": normal(j) for j in range(informative + redundant, columns)})
    return rows.select("row_id", *E.columns(columns), "y")


def write_json(df: DataFrame, path: str) -> None:
    """A small result as one JSON file in a folder."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report(df: DataFrame, rows: int = 20) -> str:
    """A small result as text."""
    return df.limit(rows).toPandas().to_string(index=False)
