"""Compression of vectors to codes of their parts, by exponion search.

Vectors are cut into equal parts, and each part place has a codebook of whole
numbers. A part looks for its nearest entry from the one that it had before: it
scans that entry's list of other entries, sorted by distance, and stops where
they are farther than the part's distance to the old entry and to the best one
found together, as by the triangle inequality none beyond can be nearer, or
as near. Distances are squares of whole numbers, so ties are exact. In the first
round the entry of the nearest norm stands for the one before.

A round is one pass: tasks assign parts, write the codes and add up each
entry's parts; only these sums meet. Codebooks, which are small, are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, table
from ._vectors import blob_column, from_blobs, matrix_parts

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2

#: Greatest size of a scaled component; greater ones count as this, so that all squares fit.
MOST = 1 << 24

#: Parts that are compared at once.
AT_ONCE = 1 << 16


def whole(x: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 x) as integers; columns of nothing are added until the parts are equal."""
    out = np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int32)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % parts)))


class Book:
    """The entries of a part place, and for each the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        gap = ((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, axis=1)
        # the roots, a little too small: what is scanned may be more than is needed, never less
        self.root = np.sqrt(self.gap.astype(np.float64)) * (1 - 1e-12)
        norm = np.sqrt((self.entries**2).sum(axis=1).astype(np.float64))
        self.by_norm = np.argsort(norm, kind="stable")
        self.norm = norm[self.by_norm]

    def start(self, x: np.ndarray) -> np.ndarray:
        """The entry of the nearest norm."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        at = np.minimum(np.searchsorted(self.norm, norm), len(self.norm) - 1)
        left = np.maximum(at - 1, 0)
        return self.by_norm[np.where(np.abs(self.norm[left] - norm) <= np.abs(self.norm[at] - norm), left, at)]

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of the nearest entry, ties to the lower index, and the distances taken."""
        kind = np.int32 if max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0))) ** 2 * 4 * x.shape[1] < 1 << 31 else np.int64
        x, entries = x.astype(kind), self.entries.astype(kind)
        best = before.astype(np.int64)
        least = ((x - entries[best]) ** 2).sum(axis=1, dtype=np.int64)
        taken = len(x)
        here = np.sqrt(least.astype(np.float64)) * (1 + 1e-12)
        open_ = np.arange(len(x))
        for step in range(len(entries)):
            # within the radius of what the old and the best entry are away
            reach = here[open_] + np.sqrt(least[open_].astype(np.float64)) * (1 + 1e-12)
            open_ = open_[self.root[before[open_], step] <= reach]
            if not len(open_):
                break
            other = self.order[before[open_], step]
            gap = ((x[open_] - entries[other]) ** 2).sum(axis=1, dtype=np.int64)
            taken += len(open_)
            better = (gap < least[open_]) | (gap == least[open_]) & (other < best[open_])
            at = open_[better]
            best[at], least[at] = other[better], gap[better]
        return best, least, taken


def assign(x: np.ndarray, codes: np.ndarray | None, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances summed over parts."""
    w = x.shape[1] // len(books)
    out, error = np.empty((len(x), len(books)), np.uint16), np.zeros(len(x), np.int64)
    for at in range(0, len(x), AT_ONCE):
        for p, book in enumerate(books):
            part = x[at : at + AT_ONCE, p * w : (p + 1) * w]
            before = book.start(part) if codes is None else codes[at : at + AT_ONCE, p].astype(np.int64)
            best, least, _ = book.nearest(part, before)
            out[at : at + AT_ONCE, p] = best
            error[at : at + AT_ONCE] += least
    return out, error


def _pack(parts: int, width: int, ids: str, labels: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrix_parts(batch.column("embedding")):
                if x.shape[1] == width:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("vec_id", "label")] + [blob_column(whole(x, parts))], ["vec_id", "label", "x"])

    return work, f"vec_id {ids}, label {labels}, x binary"


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
    codes = from_blobs(batch.column("codes"), np.uint16) if "codes" in batch.schema.names else None
    return from_blobs(batch.column("x"), np.int32), codes


def _round(shared):
    """The same rows with their new codes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, _ = assign(*_columns(batch), shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), blob_column(codes)], ["vec_id", "label", "x", "codes"])

    return work


def _sums(parts: int, entries: int, w: int):
    """(part, entry, n, s0, s1, ...) of a task."""
    names = ["part", "entry", "n", *(f"s{j}" for j in range(w))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((w, parts * entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, codes = _columns(batch)
                spot = codes.astype(np.int64) + np.arange(parts) * entries
                count += np.bincount(spot.ravel(), minlength=len(count))
                for j in range(w):
                    part = x[:, j::w].ravel()
                    # halves of the numbers, so that sums of doubles are exact
                    for half, unit in ((part >> 12, 1 << 12), (part & 0xFFF, 1)):
                        total[j] += np.bincount(spot.ravel(), weights=half, minlength=len(count)).astype(np.int64) * unit
        used = np.flatnonzero(count)
        cells = [pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(count[used]), *(pa.array(t[used]) for t in total)]
        yield pa.RecordBatch.from_arrays(cells, names)

    return work, ", ".join(f"{c} {'int' if k < 2 else 'long'}" for k, c in enumerate(names))


def _final(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = assign(*_columns(batch), shared.value)
                digits = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digits), pa.array(error)], ["vec_id", "label", "code", "error"])

    return work


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each valid vector.

    Vectors that are null, empty, or hold null or non-finite components are
    dropped, and so are those of another width than most (the narrower of
    equally frequent widths). A width that the parts do not divide is filled up
    with zeros. With fewer vectors than entries each codebook is as small.
    First entries are the rows of the least ids, null ids last; rows that share
    an id are rows each, in the order of their components. Scaled components
    beyond 2**24 count as 2**24; a label's error beyond a long is null. Other
    columns are not read. An empty table has no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"codes have two digits, so 1 to 256 entries, not {entries}")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    most = rows.where(finite).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    out = f"vec_id {kinds[0]}, code string, error long, label_error long, codebooks_sha256 string"
    if most is None:
        return spark.createDataFrame([], out)
    work, schema = _pack(parts, most.width, *kinds)
    now = rows.mapInArrow(work, schema)
    # the first entries: least ids, equal ids by their components
    head = rows.where(finite & (F.size("embedding") == most.width)).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    first = np.concatenate([whole(x, parts) for _, x in matrix_parts(head.column(0))])
    w = first.shape[1] // parts
    centres = first.reshape(len(first), parts, w).transpose(1, 0, 2).astype(np.int64)
    for _ in range(rounds):
        books = spark.sparkContext.broadcast([Book(c) for c in centres])
        now = scratch.keep(now.mapInArrow(_round(books), f"{schema}, codes binary"))
        work, names = _sums(parts, len(first), w)
        sums = now.mapInArrow(work, names).groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *(f"s{j}" for j in range(w))]]).collect()
        for r in sums:
            centres[r.part, r.entry] = [int(r[f"s{j}"]) // int(r.n) for j in range(w)]
    books = spark.sparkContext.broadcast([Book(c) for c in centres])
    final = scratch.keep(now.mapInArrow(_final(books), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long"))
    whole_label = final.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sha = hashlib.sha256(",".join(str(v) for v in centres.ravel().tolist()).encode()).hexdigest()
    both = final.join(whole_label, F.col("label").eqNullSafe(F.col("of")))
    return scratch.result(both.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_codes": op13_vector_codes}
_GAP = "list_sum(list_transform(list_zip(a.x, b.c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"


def _round_sql(k: int) -> str:
    """Assignment to the entries of round k, and the entries after it."""
    return f"""near{k} AS (SELECT vec_id, label, p, x, k, d FROM (SELECT a.*, b.k, {_GAP} AS d, row_number() OVER (PARTITION BY a.vec_id, a.p ORDER BY {_GAP}, b.k) AS r FROM parts a JOIN book{k} b ON a.p = b.p) WHERE r = 1),
sums{k} AS (SELECT p, k, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS j FROM near{k}) GROUP BY p, k, j),
book{k + 1} AS (SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT p, k, list(m ORDER BY j) AS c FROM sums{k} GROUP BY p, k) n ON n.p = b.p AND n.k = b.k)"""


ORACLE = {
    "op13_vector_codes": f"""
WITH good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM good, range({PARTS}) t(p)),
book0 AS (SELECT p, k, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {ENTRIES}),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, sha
"""
}
