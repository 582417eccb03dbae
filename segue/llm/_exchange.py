"""Entries dealt to hash buckets as packed arrays.

Many small entries (a key and who holds it) travel as one binary column per
field and bucket, so a shuffle moves a few rows of packed bytes and numpy does
the matching. Keys are combined before they leave a task (``combine``), so a
key that every document holds sends a few entries per task, not one per
document; a bucket's size follows the number of distinct keys alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix64

Fields = dict[str, np.ndarray]

#: Entries held in a task before they are dealt out.
HELD = 1 << 20


def schema_of(fields: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{x} binary" for x in fields)


def pack(fields: Fields, bucket: np.ndarray) -> pa.RecordBatch | None:
    """One row for each bucket that has entries."""
    n = len(bucket)
    if not n:
        return None
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    cuts = np.append(heads, n)
    columns = [pa.array(bucket[heads].astype(np.int32))]
    for x in fields.values():
        raw = np.ascontiguousarray(x[order])
        offsets = (cuts * raw.dtype.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]))
    return pa.RecordBatch.from_arrays(columns, ["bucket", *fields])


class Outbox:
    """Collects entries; ``full``/``close`` hand out packed batches."""

    def __init__(self, dtypes: dict[str, str], buckets: int, combine: Callable[[Fields], tuple[Fields, np.ndarray]], held: int | None = None):
        self.dtypes, self.buckets, self.combine = dtypes, buckets, combine
        self.held = HELD if held is None else held
        self.parts: list[Fields] = []
        self.n = 0

    def add(self, **fields: np.ndarray) -> None:
        self.parts.append(fields)
        self.n += len(next(iter(fields.values())))

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            whole = {k: np.concatenate([p[k] for p in self.parts]).astype(t, copy=False) for k, t in self.dtypes.items()}
            self.parts, self.n = [], 0
            fields, spots = self.combine(whole)
            batch = pack(fields, (spots % np.uint64(self.buckets)).astype(np.int64))
            if batch is not None:
                yield batch

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.n >= self.held:
            yield from self.close()


def unpack(rows: pa.Table, dtypes: dict[str, str]) -> Fields:
    return {k: np.frombuffer(b"".join(x for x in rows.column(k).to_pylist()), t) for k, t in dtypes.items()}


def exchange(sent: DataFrame, dtypes: dict[str, str], work: Callable[[Fields], pa.Table], schema: str) -> DataFrame:
    """``work`` on each bucket's entries from all tasks."""
    return sent.groupBy("bucket").applyInArrow(lambda rows: work(unpack(rows, dtypes)), schema)


def _heads(sorted_keys: tuple[np.ndarray, ...]) -> np.ndarray:
    head = np.zeros(len(sorted_keys[0]), bool)
    head[:1] = True
    for k in sorted_keys:
        head[1:] |= k[1:] != k[:-1]
    return head


def first_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of sorted arrays, the first place that has the same of all."""
    head = _heads(sorted_keys)
    return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


def last_of(*sorted_keys: np.ndarray) -> np.ndarray:
    head = _heads(sorted_keys)
    n = len(head)
    tail = np.append(head[1:], True)[:n]
    return np.minimum.accumulate(np.where(tail, np.arange(n), n)[::-1])[::-1]


def grouped(keys: list[np.ndarray], values: np.ndarray, names: list[str]) -> pa.Table:
    """Rows (keys..., values as one binary) for each distinct tuple of keys."""
    n = len(values)
    order = np.lexsort([values, *reversed(keys)])
    keys, values = [k[order] for k in keys], np.ascontiguousarray(values[order])
    heads = np.flatnonzero(_heads(tuple(keys)))
    offsets = (np.append(heads, n) * values.dtype.itemsize).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
    return pa.Table.from_arrays([*(pa.array(k[heads]) for k in keys), blob], names)


#: Bits of the filter in ``likely``; fixed, whatever the number of keys.
FILTER_BITS, FILTER_SLOTS = 23, 64


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros((FILTER_SLOTS, (1 << FILTER_BITS) // FILTER_SLOTS), bool)
    for batch in batches:
        flags.ravel()[_spots(batch.column(0))] = True
    used = np.flatnonzero(flags.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(flags[k]).tobytes() for k in used], pa.binary())], ["slot", "bits"])


def _spots(keys: pa.Array) -> np.ndarray:
    return (mix64(keys.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _either(rows: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows.column("bits").to_pylist()])
    return pa.table({"slot": rows.column("slot").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long ``key`` may be among those of ``wanted``.

    A bit map of fixed size goes to all tasks, so that rows that a join would
    drop needn't be shuffled first. With more keys it lets more rows by; it
    never drops one that the join needs.
    """
    found = wanted.select(key).mapInArrow(_bits, "slot int, bits binary").groupBy("slot").applyInArrow(_either, "slot int, bits binary")
    flags = np.zeros((FILTER_SLOTS, (1 << FILTER_BITS) // FILTER_SLOTS // 8), np.uint8)
    for r in found.collect():
        flags[r.slot] = np.frombuffer(r.bits, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(flags.ravel())
    spot = df.columns.index(key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _spots(batch.column(spot))
            yield batch.filter(pa.array(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))

    return df.where(F.col(key).isNotNull()).mapInArrow(work, df.schema)
