"""What a run did, gathered while it ran: the passes over the rows, and what each saw, are observed in the passes
themselves, so a record costs no scan."""

from __future__ import annotations

import contextlib
import platform
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SCHEMA = "estimator string, d int, n long, seed long, passes int, rows_read long, label_min double, label_max double, label_sum double, kappa double, epsilon double, calibration string, seconds double, spark string, python string, numpy string, arrow string, blas string"


class _Open(threading.local):
    """The records that are open in a thread; each has a list of what its passes saw."""

    def __init__(self):
        self.records: list[list[dict]] = []


_open = _Open()


@contextlib.contextmanager
def recording() -> Iterator[list[dict]]:
    """A list that gets a dict (rows, low, high, total: of the labels) for each pass of a fit made inside."""
    seen: list[dict] = []
    _open.records.append(seen)
    try:
        yield seen
    finally:
        _open.records.remove(seen)


def observed(frame: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """frame (.., y) to make a pass over, and what to call once it is made; nothing is added if no record is open."""
    if not _open.records:
        return frame, lambda: None
    watch, records = Observation(), list(_open.records)
    y = F.col("y")
    frame = frame.observe(watch, F.count(F.lit(1)).alias("rows"), F.min(y).alias("low"), F.max(y).alias("high"), F.sum(y).alias("total"))

    def done() -> None:
        for record in records:
            record.append(dict(watch.get))

    return frame, done


def _blas() -> str:
    build = np.show_config(mode="dicts").get("Build Dependencies", {}).get("blas", {})
    return f"{build.get('name', 'unknown')} {build.get('version', '')}".strip()


def recorded_fit(df: DataFrame, spec, config=None):
    """(the fitted set, one row on how it came about).

    passes are those over all rows, rows_read what they read together; n and the labels' range and sum are what the last
    one saw.  seed is that of the configuration; versions are the driver's.
    """
    from nearopt.operators.fit import fit

    began = time.perf_counter()
    with recording() as seen:
        fitted = fit(df, spec, config)
    last, c = seen[-1], fitted.config
    row = (
        c.estimator, fitted.d, last["rows"], c.random_state, len(seen), sum(p["rows"] for p in seen), last["low"], last["high"], last["total"], fitted.kappa, fitted.epsilon, fitted.calibration,
        time.perf_counter() - began, df.sparkSession.version, platform.python_version(), np.__version__, pa.__version__, _blas(),
    )
    return fitted, df.sparkSession.createDataFrame([row], SCHEMA)
