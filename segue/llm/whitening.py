"""Whitening of embeddings by cyclic Jacobi rotations of their exact covariance.

Components become integers, so sums and centred scatter are exact whatever the
number of tasks: entries are centred at the whole number next to their mean
before they are multiplied, tasks add up integers, and the rest of the mean is
taken off in exact arithmetic. The driver gets one d x d matrix, turns it by
Jacobi rotations in extended precision until nothing is left beside the
diagonal, and broadcasts the whitening matrix; a last pass measures how near
to the identity the whitened vectors' own covariance is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table
from ._vectors import matrix_parts

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32

#: Greatest size of a scaled component, up to which all sums are exact; greater ones count as this.
MOST = 1 << 40

#: Greatest number of dimensions: the driver holds a few matrices of its square.
MOST_DIMS = 4096

#: Least eigenvalue that is told from nothing, as a part of the greatest.
NOTHING = 1e-15

#: Rows whose products are added up at once.
ROWS = 4096


def whole(x: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000, as long."""
    return np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int64) + SHIFT


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers) of the vectors of this width."""
    for rows, x in matrix_parts(column):
        if x.shape[1] == width:
            return rows, whole(x)
    return np.empty(0, np.int64), np.empty((0, width), np.int64)


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of the columns of integers of up to 63 bits."""
    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
    return [(int(h) << 32) + int(s) for s, h in zip(low, high, strict=True)]


def exact_scatter(y: np.ndarray) -> np.ndarray:
    """y.T @ y in whole numbers, as objects where they may need more than 53 bits."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64)
    if most * most * len(y) < 1 << 63:
        return y.T @ y
    z = y.astype(object)
    return z.T @ z


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix by cyclic rotations, in extended precision."""
    a = np.array(a, np.longdouble)
    d = len(a)
    v = np.eye(d, dtype=np.longdouble)
    eps = np.finfo(np.longdouble).eps
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= eps * np.sqrt(abs(a[p, p] * a[q, q])) or off == 0:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                # columns, then rows; what the pair has in common vanishes
                ap, aq = a[:, p].copy(), a[:, q].copy()
                a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
                ap, aq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * ap - s * aq, s * ap + c * aq
                a[p, q] = a[q, p] = 0
                vp, vq = v[:, p].copy(), v[:, q].copy()
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    return np.diag(a).copy(), v


class Whitening:
    """What the fit list gives: n, sums, eigenvalues by fall, whitening matrix (dimensions x components)."""

    def __init__(self, n: int, sums: list[int], middle: np.ndarray, scatter: np.ndarray, components: int):
        self.n, self.sums, self.middle = n, sums, middle
        d = len(sums)
        rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]  # n times the mean, less the middle
        self.shift = np.array([r / n for r in rest])
        cov = np.array([[np.longdouble(n * int(scatter[i, j]) - rest[i] * rest[j]) / np.longdouble(n * n) for j in range(d)] for i in range(d)], np.longdouble)
        self.trace = cov.trace()
        values, vectors = jacobi(cov)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        some = int((values > max(values[0], 0) * NOTHING * d).sum())
        some = min(some, components)
        self.values, vectors = values[:some], vectors[:, :some]
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(some)])  # the largest entry is positive
        self.matrix = (vectors * signs / np.sqrt(self.values)).astype(np.float64)
        self.explained = (self.values / self.trace).astype(np.float64) if some else np.empty(0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle).astype(np.float64) - self.shift) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2; null where that is not a long."""
        y = x - self.middle
        rest = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.middle, strict=True)], object)
        most = int(np.abs(y).max(initial=0)) * self.n + max((abs(int(r)) for r in rest), default=0)
        if most * most * len(self.sums) < 1 << 63:
            z = y * self.n - rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * self.n - rest
        return [v if v < 1 << 63 else None for v in (z * z).sum(axis=1).tolist()]


def _ints(values) -> pa.Array:
    return pa.array([int(v) for v in values], pa.decimal128(38, 0))


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, j, n, s): vectors of each width, and the sums of their dimensions."""
    found: dict[int, list] = {}
    for batch in batches:
        for rows, x in matrix_parts(batch.column(0)):
            n, sums = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            found[x.shape[1]] = [n + len(rows), [a + b for a, b in zip(sums, exact_sum(whole(x)), strict=True)]]
    for width, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), _ints(sums)], ["width", "j", "n", "s"])


def _scatter(middle: np.ndarray):
    """(i, j, s) for i <= j: scatter of the task's vectors about the middle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = _vectors(batch.column(0), len(middle))
            for at in range(0, len(x), ROWS):
                part = exact_scatter(x[at : at + ROWS] - middle).astype(object)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(middle))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _ints(total[i, j])], ["i", "j", "s"])

    return work


def _identity(shared):
    """(i, j, s) for i <= j: the task's part of the scatter of the whitened vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total = np.zeros((w.matrix.shape[1],) * 2)
        for batch in batches:
            _, x = _vectors(batch.column(0), len(w.middle))
            y = w.whitened(x)
            total += y.T @ y
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    return work


def fit(vectors: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a frame with a column of vectors alone; null where there is no valid vector.

    Vectors of another width than most (the narrower of equally frequent
    widths) take no part.
    """
    sums = vectors.mapInArrow(_sum_up, "width int, j int, n long, s decimal(38,0)").groupBy("width", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    widest = sums.where("j = 0").orderBy(F.desc("n"), "width").select("width", "n").first()
    if widest is None:
        return None
    if widest.width > MOST_DIMS:
        raise ValueError(f"{widest.width} dimensions, more than {MOST_DIMS}, whose matrix one machine is asked to turn")
    totals = [int(r.s) for r in sums.where(F.col("width") == widest.width).orderBy("j").collect()]
    n = int(widest.n)
    middle = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    parts = vectors.mapInArrow(_scatter(middle), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    scatter = np.zeros((len(totals),) * 2, object)
    i, j = (parts.column(c).to_numpy() for c in "ij")
    scatter[i, j] = scatter[j, i] = np.array([int(v) for v in parts.column("s").to_pylist()], object)
    return Whitening(n, totals, middle, scatter, components)


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each valid vector and component.

    Vectors that are null, empty, or hold null or non-finite components take no
    part, nor do those of another width than most. Directions in which the
    vectors do not differ are no components, so equal vectors, or one alone,
    have no rows. Rows that share an id, or have none, are rows each. Scaled
    components beyond 2**40 count as 2**40; a deviation beyond a long is null.
    Other columns are not read. An empty table has no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    only = rows.select("embedding")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {WHITENED}"
    w = fit(only, components=components)
    if w is None or not len(w.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(w)
    k = len(w.values)
    parts = only.mapInArrow(_identity(shared), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    gap = parts.column("s").to_numpy() / w.n - (parts.column("i").to_numpy() == parts.column("j").to_numpy())
    error = float(np.abs(gap).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            at, x = _vectors(batch.column("embedding"), len(w.middle))
            if not len(at):
                continue
            y = w.whitened(x)
            ids = pc.take(batch.column("vec_id"), pa.array(np.repeat(at, k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, w.n)), pc.take(pa.array(w.deviation(x), pa.int64()), pa.array(np.repeat(np.arange(len(at)), k)))]
            columns += [pa.array(y.ravel()), pa.array(np.tile(w.explained, len(at))), pa.array(np.full(len(at) * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", *(c.split()[0] for c in WHITENED.split(", "))])

    return rows.mapInArrow(work, schema)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
ORACLE: dict[str, str] = {}
