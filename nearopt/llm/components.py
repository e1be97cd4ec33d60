"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearopt.llm.util import dropped, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _least(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """The least value by key, as a table: joins with it have plain exchanges, whose hot keys Spark can split."""
    return written(pairs.groupBy(F.col(key).alias("node")).agg(F.min(value).alias("least")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b) that isn't the smallest of its component.

    component is the smallest id that can be reached.  Edges may repeat, run either way, or be loops; rows with a
    null end count for nothing.  Each round's edges are written, so no lineage grows, and each step is an
    aggregate with map-side minima, a join, and a distinct over whole edges; rounds grow with the logarithm of
    the longest path.
    """
    now = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(now.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        low = _least(both, "node", "other")
        large = written(both.join(low, "node").where("other > node").select(F.col("other").alias("hi"), F.least("least", "node").alias("lo")).distinct(), "large")
        dropped(now)
        dropped(low)
        low = _least(large, "hi", "lo")
        rest = large.withColumnRenamed("hi", "node").join(low, "node").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        now = written(low.select(F.col("node").alias("hi"), F.col("least").alias("lo")).unionByName(rest).distinct(), "edges")
        dropped(large)
        dropped(low)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
