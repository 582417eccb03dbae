"""Exact top-k inner products by no-random-access aggregation.

Every component of the candidates of a block is one sorted list; a query reads
a list from its high end where its own component is positive, else from the
low end. Lists are read in steps to the ``DEPTHS``. What has been read is added
up, so after each step a candidate's score lies between that plus the lists'
far ends, and that plus the places reached. A query stops when no candidate but
a few can reach the k-th best lower bound (or that of earlier blocks); the few
are then resolved to their whole scores. At the lists' end both bounds are the
score. Bounds of all queries of a block come from one product of matrices.

Query blocks meet cells of candidate blocks in a grid, every cell of bounded
size. Cells come in waves, each several times as large as all before, and the
k-th best score of the waves before goes along with a query; so a query brings
k rows out of the first wave's cells, and few more out of each later wave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, table
from ._vectors import blob_column, from_blobs, matrix_parts

K, SCALE = 20, 64

#: Shares of the lists that are read before bounds are looked at.
DEPTHS = (0.125, 0.5, 0.75, 0.9, 1.0)

#: Queries and candidates that meet at once; candidates of a cell; cells of the first wave, and of the next for each before.
QUERIES_IN_BLOCK, ROWS_IN_BLOCK, ROWS_IN_CELL, WAVE, GROWTH = 1024, 4096, 16384, 64, 7

#: A query stops when so many candidates for each of the k (a quarter of the block at most), or this share of the block, are left to resolve.
FEW, SHARE = 4, 1 / 16

LEAST = np.iinfo(np.int64).min + 1


def best_of_block(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each query the rows (by index) and scores of its k best in a block, and the share of the lists that it read.

    ``rows`` are in the order of ids. ``own`` are the queries' row numbers,
    which ``rids`` holds for the rows. ``floor`` has k-th best scores known so
    far; rows below are left out. Ties go to the smaller id.
    """
    n, dims = rows.shape
    share = np.ones(len(queries))
    if n == 0 or len(queries) == 0:
        return [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries), share
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * dims
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    nothing = kind(-np.inf) if kind is not np.int64 else LEAST - 1
    x, q = rows.astype(kind), queries.astype(kind)
    high, low = np.maximum(q, 0).T, np.minimum(q, 0).T
    order = np.argsort(x, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    ends = np.take_along_axis(x, order, axis=0)
    mine = {int(r): i for i, r in enumerate(rids)}
    self_at = np.array([mine.get(int(r), -1) for r in own])
    floor = floor.astype(np.float64 if kind is not np.int64 else np.int64)
    out: list = [None] * len(q)
    open_ = np.arange(len(q))
    read = np.zeros((n, len(q)), kind)
    before = 0
    for depth_share in DEPTHS:
        depth = n if depth_share >= 1 else int(depth_share * n)
        if depth <= before:
            continue
        # the next part of each list, from either end
        high_new, low_new = (place >= n - depth) & (place < n - before), (place < depth) & (place >= before)
        read += np.where(high_new, x, 0) @ high[:, open_] + np.where(low_new, x, 0) @ low[:, open_]
        before = depth
        lower = upper = read
        if depth < n:
            high_left, low_left = place < n - depth, place >= depth
            rest = lambda far_high, far_low: np.where(high_left, far_high, 0) @ high[:, open_] + np.where(low_left, far_low, 0) @ low[:, open_]  # noqa: B023, E731
            upper = read + rest(ends[n - depth - 1], ends[depth])
            lower = read + rest(ends[0], ends[-1])
        has = self_at[open_] >= 0
        lower, upper = (b.copy() if b is read else b for b in (lower, upper))
        for bound in (lower, upper):
            bound[self_at[open_][has], np.flatnonzero(has)] = nothing
        kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(open_), nothing)
        kth = np.maximum(kth, floor[open_])
        alive = upper >= kth
        done = np.ones(len(open_), bool) if depth == n else alive.sum(axis=0) <= max(min(FEW * k, n / 4), SHARE * n)
        for j in np.flatnonzero(done).tolist():
            i = open_[j]
            at = np.flatnonzero(alive[:, j])
            s = np.rint(read[at, j]).astype(np.int64) if depth == n else rows[at] @ queries[i]
            at, s = at[s >= floor[i]], s[s >= floor[i]]
            best = np.argsort(-s, kind="stable")[:k]
            out[i], share[i] = (at[best], s[best]), depth / n
        open_, read = open_[~done], read[:, ~done]
        if not len(open_):
            break
    return out, share


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, vec_id, width, x): valid vectors as integers."""
    for batch in batches:
        for rows, x in matrix_parts(batch.column("embedding")):
            whole = np.floor(SCALE * x)
            whole = np.clip(whole, -(2.0**62), 2.0**62).astype(np.int64)
            ids = [batch.column(k).take(pa.array(rows)) for k in ("rid", "vec_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(rows), x.shape[1], np.int32)), blob_column(whole)], ["rid", "vec_id", "width", "x"])


def _block(rows: pa.Table) -> pa.Table:
    """One row: a block of queries of one width."""
    x = from_blobs(rows.column("x"), np.int64)
    small = np.abs(x).max(initial=0) < 1 << 15
    data = x.astype(np.int16) if small else x
    cells = [rows.column("qb").slice(0, 1), rows.column("width").slice(0, 1)]
    blobs = [rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("rid", "vec_id", "floor")]
    return pa.Table.from_arrays([*cells, pa.array([bool(small)]), *(pa.array([b], pa.binary()) for b in [*blobs, data.tobytes()])], ["qb", "width", "small", "rids", "ids", "floor", "x"])


def _candidates(rows: pa.Table) -> pa.Table:
    """Blocks of the candidates of one cell and width, rows in the order of ids."""
    order = np.lexsort([rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy()])
    x = from_blobs(rows.column("x"), np.int64)
    ids, rids = (rows.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "rid"))
    small = bool(np.abs(x).max(initial=0) < 1 << 15)
    cuts = [order[at : at + ROWS_IN_BLOCK] for at in range(0, len(order), ROWS_IN_BLOCK)]
    same = [pa.array(np.full(len(cuts), rows.column(c)[0].as_py(), np.int32)) for c in ("cell", "width")]
    blobs = [pa.array([(v[c]).tobytes() for c in cuts], pa.binary()) for v in (rids, ids, x.astype(np.int16) if small else x)]
    return pa.Table.from_arrays([*same, pa.array([small] * len(cuts)), *blobs], ["cell", "width", "small", "rids", "ids", "x"])


def _numbers(width: int, small: bool, blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int16 if small else np.int64).reshape(-1, width).astype(np.int64)


def _meet(k: int):
    """One query block and the candidate blocks of a cell."""

    def work(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = {c: [np.empty(0, np.int64)] for c in ("q_rid", "query_id", "vec_id", "rid", "score")}
        for c in asked.to_pylist():
            queries = _numbers(c["width"], c["small"], c["x"])
            own, q_ids, floor = (np.frombuffer(c[name], np.int64).copy() for name in ("rids", "ids", "floor"))
            for g in given.to_pylist():
                rids, ids = np.frombuffer(g["rids"], np.int64), np.frombuffer(g["ids"], np.int64)
                best, _ = best_of_block(queries, own, _numbers(g["width"], g["small"], g["x"]), ids, rids, k, floor)
                for i, (_, s) in enumerate(best):
                    if len(s) == k:
                        floor[i] = max(floor[i], s[-1])
                sizes = [len(a) for a, _ in best]
                at = np.concatenate([a for a, _ in best])
                for name, part in (("q_rid", np.repeat(own, sizes)), ("query_id", np.repeat(q_ids, sizes)), ("vec_id", ids[at]), ("rid", rids[at]), ("score", np.concatenate([s for _, s in best]))):
                    found[name].append(part)
        return pa.table({name: np.concatenate(parts) for name, parts in found.items()})

    return work


FOUND = "q_rid long, query_id long, vec_id long, rid long, score long"


def top_k(vectors: DataFrame, is_query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest inner products.

    Components become floor(64 * x). Queries are the rows for which
    ``is_query`` holds (else ids divisible by 20); candidates are all other
    rows of the same width. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without an id. Ties go to
    the smaller id. Rows that share an id are each a query and a candidate of
    their own. Scores are exact while they fit into 63 bits. A query without
    candidates has no rows; an empty table has none.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    cond = F.col(id_col) % 20 == 0 if is_query is None else is_query
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), cond.alias("asks"))
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()))
    packed = "rid long, vec_id long, width int, x binary"
    n, whole = rows.agg(F.count_if("asks"), F.count("*")).first()
    blocks, cells = max(1, -(-n // QUERIES_IN_BLOCK)), max(1, -(-whole // ROWS_IN_CELL))
    queries = rows.where("asks").select("rid", "vec_id", "embedding").mapInArrow(_pack, packed)
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    given = rows.select("rid", "vec_id", "embedding").mapInArrow(_pack, packed)
    given = given.withColumn("cell", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(cells)).cast("int"))
    given = given.groupBy("cell", "width").applyInArrow(_candidates, "cell int, width int, small boolean, rids binary, ids binary, x binary")
    given = scratch.keep(given)

    best, at = None, 0
    while at < cells:
        upto = min(cells, max(WAVE, at * (1 + GROWTH)))
        asked = queries.withColumn("floor", F.lit(int(LEAST)))
        if best is not None:  # what a later row must reach
            floors = best.where(F.col("rank") == k).select(F.col("q_rid").alias("rid"), F.col("score").alias("reached"))
            asked = queries.join(floors, "rid", "left").withColumn("floor", F.coalesce("reached", F.lit(int(LEAST)))).drop("reached")
        asked = asked.groupBy("qb", "width").applyInArrow(_block, "qb int, width int, small boolean, rids binary, ids binary, floor binary, x binary")
        asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(at), F.lit(upto - 1))))
        wave = given.where(F.col("cell").between(at, upto - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["qb", "cell", "width"]
        met = asked.groupBy(*key).cogroup(wave.groupBy(*key)).applyInArrow(_meet(k), FOUND)
        if best is not None:
            met = met.union(best.drop("rank"))
        order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
        best = scratch.keep(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        at = upto
    return scratch.result(best.select("query_id", "rank", "vec_id", "score"))


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_exact_topk": op10_exact_topk}

ORACLE = {
    "op10_exact_topk": """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}
