"""Columns of vectors as Arrow hands them over, without a Python object for each component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from nearopt.llm import textvec as tv


def usable(column: pa.Array, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which lists of a column are vectors that can be compared, and of these the lengths and the components as bytes.

    Lists that are null, empty, all zero or hold a null or non-finite component are not.  -0.0 is 0.0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # nulls become NaN
    ends = np.cumsum(size)
    count = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[ends] - c[ends - size]
    ok = (size > 0) & (count(np.isfinite(flat)) == size) & (count(flat != 0) > 0)
    if not ok.all():
        flat, size = flat[np.repeat(ok, size)], size[ok]
    width = flat.dtype.itemsize
    bounds = np.concatenate([[0], np.cumsum(size) * width]).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))])
    return ok, size, values


def keys(values: pa.Array) -> np.ndarray:
    """A 128-bit key of each byte string, as two longs."""
    raw, bounds = tv.buffers(values.cast(pa.large_binary()))
    view, at = memoryview(np.ascontiguousarray(raw)), bounds.tolist()
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(at, at[1:])), "<i8").reshape(-1, 2)


def rows(values, dtype) -> np.ndarray:
    """Byte strings of equal length, a list or a column without nulls, as rows of a matrix."""
    if isinstance(values, list):
        return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1) if values else np.empty((0, 0), dtype)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.empty((0, 0), dtype)
    raw, _ = tv.buffers(values.cast(pa.large_binary()))
    return raw.reshape(len(values), -1).copy().view(dtype)


def padded(values: pa.Array, width: int, kind: type) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled with zeros, which change no product of equal lengths."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.empty((0, width))
    raw, bounds = tv.buffers(values.cast(pa.large_binary()))
    flat, size = np.ascontiguousarray(raw).view(kind), np.diff(bounds) // np.dtype(kind).itemsize
    if (size == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(values), width))
    out[np.arange(width) < size[:, None]] = flat
    return out
