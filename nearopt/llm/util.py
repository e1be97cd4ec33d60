"""Shared helpers: tables in the cluster's shared folder, size-checked broadcasts, stable hashes."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearopt.storage import new_path

#: Ids up to which a set of them is broadcast (about 35 MB as a hash table); beyond it, a shuffle join is used.
BROADCAST_IDS = 500_000


class _Scopes(threading.local):
    """The open scratch() blocks of a thread: queries in other threads keep their tables."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


@contextlib.contextmanager
def scratch():
    """Tables that written() makes inside are deleted at the end, but for those given to the function yielded."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.open.append(own)
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _scopes.open.pop()
        for table in own:
            if not any(table is k for k in kept):
                dropped(table)
        if _scopes.open:
            _scopes.open[-1].extend(kept)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back: lineage ends here and losing executors costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.nearopt_path = path
    if _scopes.open:
        _scopes.open[-1].append(back)
    return back


def dropped(table: DataFrame) -> None:
    """Delete a table of written() that no later step reads."""
    spark, path = table.sparkSession, table.nearopt_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def having(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is in the one-column table ids, which is broadcast only if its counted size allows.  The
    columns of df stay as they are, in their order."""
    name = free("id", df)
    ids = ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(f"`{key}`") == F.col(name), how)


def free(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores after it as make it no column of the frames, in whatever case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def md5_hex(seed: int | str, column: Column) -> Column:
    """The md5 of "seed:value" in hex; null counts as the text "null"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))).cast("binary"))


def unit(hexed: Column) -> Column:
    """The first eight hex digits as a double in [0, 1)."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
