"""Packing of embedding columns into blocks of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix_parts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in a list column, as doubles.

    Null vectors, empty vectors and vectors that hold null or non-finite
    components are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    first = np.cumsum(size) - size
    out = []
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = flat[first[rows][:, None] + np.arange(n)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            out.append((rows[good], x[good]))
    return out


def blob_column(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary."""
    raw = np.ascontiguousarray(x)
    width = raw.shape[1] * raw.dtype.itemsize
    offsets = (np.arange(len(raw) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def from_blobs(column, dtype=np.float64) -> np.ndarray:
    """The matrix of binaries of one length."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype).reshape(len(parts), -1) if parts else np.empty((0, 0), dtype)
