"""Operations of a training-data pipeline: formatting, near-duplicates, search, scans, mixing and packing."""

from nearopt.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
