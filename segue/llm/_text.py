"""Vectorised work on the bytes of many texts at once.

Texts of an Arrow column are taken in runs of about ``CHUNK`` bytes, so the
arrays of a run stay small whatever the batch; a longer text is a run alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
MOST_ROWS = 4096

#: Fixed: the ASCII white space between words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size + 1, np.uint64(b), np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and of its inverse."""
    size = 1 << 16
    while size < n:
        size *= 2
    up, down = _powers(base, size)
    return up[: n + 1], down[: n + 1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span, by prefix sums."""
    n = len(codes)
    up, down = powers(base, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64))


def window_hashes(codes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all windows of so many codes (len(codes) - width + 1 of them)."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(base, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up[:n], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[: n - width + 1])


class Run:
    """Some rows' texts as one byte array. Nulls count as empty."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each row's first word (rows + 1 long)."""
        data = self.data if data is None else data
        n = len(data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(IS_SPACE[data], out=inside[:n])
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1]
        finishes = inside[:n] & ~inside[1:]
        cuts = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[cuts] = inside[cuts]
        cuts = cuts[1:] - 1 if len(cuts) else cuts
        finishes[cuts] = inside[cuts]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def runs(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK, most_rows: int = MOST_ROWS) -> Iterator[Run]:
    """The column's texts in runs; every row is in one run, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null("" if kind == pa.large_string() else b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1
        to = min(max(to, at + 1), at + most_rows, n)
        yield Run(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of these lengths: each element's row, and its place in the row."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return rows, np.arange(len(rows)) - first[rows]


def gather(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[first:first + length] over all rows."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    at = np.cumsum(lengths) - lengths
    return flat[np.repeat(first - at, lengths) + np.arange(total)]
