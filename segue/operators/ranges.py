"""Joins of values to the ranges that hold them.

Ranges are a table of any size and may overlap: a value belongs to the first
range, by an order, that holds it, both ends included. Ends are dealt to buckets of
about as many each. A range lies in the buckets of its two ends, and over the
buckets between; of those, which it covers whole, only the first range of each
counts, found by halves of halves of the buckets, so a long range is a few
rows and not one for each bucket. Inside a bucket ranges are painted in their
order onto the stretches between ends, and what is left are stretches of one
range each: a value finds its own by bisection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Ends in a bucket, about; buckets at most; stretches that go to every task, at most; rows that one task searches for at once beyond that.
ENDS, MOST_BUCKETS, BROADCAST, ROWS = 4096, 1024, 1 << 20, 1 << 20

STRETCHES = "bucket int, at double, point long, gap long"


def edges_of(ranges: DataFrame, lo: str, hi: str) -> np.ndarray:
    """The least end of each bucket but the first: quantiles of all ends."""
    ends = ranges.select(F.explode(F.array(F.col(lo).cast("double"), F.col(hi).cast("double"))).alias("e"))
    n = ends.count()
    buckets = int(min(MOST_BUCKETS, max(1, n // ENDS)))
    if buckets < 2:
        return np.empty(0)
    found = ends.agg(F.percentile_approx("e", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0]
    return np.unique(found)


def halves(a: int, b: int) -> list[tuple[int, int]]:
    """Buckets a to b - 1 as aligned blocks (level, index): a block of level k has 2**k buckets."""
    out, level = [], 0
    while a < b:
        if a & 1:
            out.append((level, a))
            a += 1
        if b & 1:
            b -= 1
            out.append((level, b))
        a, b, level = a >> 1, b >> 1, level + 1
    return out


def paint(lo: np.ndarray, hi: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """For each of n cells the least order of the ranges lo to hi (included) over it, or -1.

    Ranges paint in their order; a cell that is painted is jumped over.
    """
    out, ahead = np.full(n, -1, np.int64), list(range(n + 1))
    for k in np.argsort(order, kind="stable").tolist():
        at, end, mark = int(lo[k]), int(hi[k]), int(order[k])
        while True:
            root = at
            while ahead[root] != root:
                root = ahead[root]
            while ahead[at] != root:
                ahead[at], at = root, ahead[at]
            if root > end:
                break
            out[root] = mark
            ahead[root] = root + 1
            at = root
    return out


def stretches(ranges: DataFrame, lo: str, hi: str, order: str, edges: np.ndarray) -> DataFrame:
    """(bucket, at, point, gap): at every end, the order of the first range that holds it, and of the first that holds what follows up to the next end.

    Every bucket begins with an end at its edge. Orders are whole numbers,
    each of one range; -1 is none.
    """
    top = len(edges)
    rows = ranges.select(F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi"), F.col(order).cast("long").alias("o")).where("lo <= hi AND o IS NOT NULL AND NOT isnan(hi)")
    found = np.asarray(edges, float)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ranges in the buckets of their ends; those over whole buckets as blocks, the first of each."""
        first: dict[tuple[int, int], int] = {}
        for batch in batches:
            a, b = np.searchsorted(found, batch.lo, side="right"), np.searchsorted(found, batch.hi, side="right")
            for i, j, o in zip(a.tolist(), b.tolist(), batch.o.tolist(), strict=True):
                for block in halves(i + 1, j):
                    first[block] = min(first.get(block, o), o)
            one = pd.DataFrame({"bucket": a, "lo": batch.lo, "hi": np.where(a == b, batch.hi, np.inf), "o": batch.o})
            two = pd.DataFrame({"bucket": b, "lo": -np.inf, "hi": batch.hi, "o": batch.o})[a < b]
            yield pd.concat([one, two])
        for (level, index), o in first.items():
            yield pd.DataFrame({"bucket": np.arange(index << level, (index + 1) << level), "lo": -np.inf, "hi": np.inf, "o": o})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows.bucket.iloc[0])
        low, high = rows.lo.to_numpy(), rows.hi.to_numpy()
        start = found[b - 1] if b else -np.inf
        at = np.unique(np.concatenate([low[np.isfinite(low)], high[np.isfinite(high)], [start]]))
        cells = 2 * np.searchsorted(at, np.maximum(low, start))
        ends = np.where(np.isfinite(high), 2 * np.searchsorted(at, high), 2 * len(at) - 1)
        cover = paint(cells, ends, rows.o.to_numpy(), 2 * len(at))
        return pd.DataFrame({"bucket": b, "at": at, "point": cover[::2], "gap": cover[1::2]})

    dealt = rows.mapInPandas(deal, "bucket int, lo double, hi double, o long").groupBy("bucket", "lo", "hi").agg(F.min("o").alias("o"))
    empty = ranges.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("bucket"), F.lit(float("-inf")).alias("lo"), F.lit(float("-inf")).alias("hi"), F.lit(None).cast("long").alias("o"))
    both = dealt.unionByName(empty.join(dealt.select("bucket").distinct(), "bucket", "left_anti"))
    return both.groupBy("bucket").applyInPandas(lambda rows: whole(rows) if rows.o.notna().all() else whole(rows.assign(o=-1, hi=np.inf)), STRETCHES)


def first_range(rows: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, order: str, out: str = "first") -> DataFrame:
    """The rows with ``out``: the order of the first range that holds their value; null where none does, or the value is null or no number.

    ``order`` is a whole number, each of one range; ranges without an order, or
    whose ends are null or in the wrong order, hold nothing. Where the
    stretches are few, they go to all tasks and rows stay where they are; else
    rows meet their bucket's stretches, in parts of bounded size.
    """
    edges = edges_of(ranges, lo, hi)
    schema = StructType([*rows.schema.fields, StructField(out, LongType())])
    cells = stretches(ranges, lo, hi, order, edges).persist()
    if cells.count() <= BROADCAST:
        table = cells.orderBy("at").toArrow()
        at, point, gap = (table.column(c).to_numpy() for c in ("at", "point", "gap"))
        cells.unpersist()
        shared = rows.sparkSession.sparkContext.broadcast((at, point, gap))
        spot = rows.columns.index(value)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = _found(_numbers(batch.column(spot)), *shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, hit], [*batch.schema.names, out])

        return rows.mapInArrow(work, schema)
    # parts of every bucket, so that a value which many rows have is not one task's
    parts = max(1, -(-rows.count() // ROWS))
    key, part = "_bucket", "_part"
    kind = StructType([*rows.schema.fields, StructField(part, LongType()), StructField(key, IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.searchsorted(edges, _numbers(batch.column(value)), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], [*batch.schema.names, key])

    dealt = rows.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(parts))).mapInArrow(deal, kind)
    given = cells.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(asked: pa.Table, stretch: pa.Table) -> pa.Table:
        order_ = np.argsort(stretch.column("at").to_numpy())
        at, point, gap = (stretch.column(c).to_numpy()[order_] for c in ("at", "point", "gap"))
        return asked.drop_columns([key, part]).append_column(out, _found(_numbers(asked.column(value)), at, point, gap))

    return dealt.groupBy(key, part).cogroup(given.groupBy(F.col("bucket"), part)).applyInArrow(meet, schema)


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Doubles; nulls are no numbers."""
    return np.asarray(column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64(), safe=False).to_numpy())


def _found(v: np.ndarray, at: np.ndarray, point: np.ndarray, gap: np.ndarray) -> pa.Array:
    spot = np.searchsorted(at, v, side="right") - 1
    known = (spot >= 0) & ~np.isnan(v)
    spot = np.maximum(spot, 0)
    hit = np.where(at[spot] == v, point[spot], gap[spot]) if len(at) else np.full(len(v), -1)
    return pa.array(hit, pa.int64(), mask=~known | (hit < 0))
