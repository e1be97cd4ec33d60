"""Queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearopt.plans import calls, catalog, preparation, whole_set
from nearopt.plans.catalog import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

_ALL = catalog.QUERIES | preparation.QUERIES | calls.QUERIES | whole_set.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
