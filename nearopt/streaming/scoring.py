"""Certificates for rows that arrive: they depend on a row alone, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearopt.operators import certify
from nearopt.operators.fit import FittedSet


def score_stream(fitted: FittedSet, rows: DataFrame, tau: float = 0.0) -> DataFrame:
    """Bands of a streaming frame of rows with the set's feature columns."""
    if not rows.isStreaming:
        raise ValueError("a streaming frame is needed")
    return certify.bands(fitted, rows, tau)


def start(fitted: FittedSet, rows: DataFrame, path: str, checkpoint: str, tau: float = 0.0) -> StreamingQuery:
    """Writes the bands of a stream as Parquet, exactly once by its checkpoint, until no more rows are there."""
    return score_stream(fitted, rows, tau).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
