"""Scaling, weights, k-means with restarts, number of clusters, and refinement.

Equal rows are counted first, so rows are distinct vectors with weights. A fit
keeps all restarts of all cluster counts going at once: each round is one pass
over the rows, in which every task adds up the sums of every model, and only
these sums (models x clusters x features) meet. Seeds come from all rows by a
few rounds of oversampling (k-means||): a row is drawn by its squared distance
from what is drawn so far, and what is drawn weighs what it stands for. Draws
are hashed from the distinct vectors, so reruns agree. Statistics are the
population's.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass
from functools import lru_cache, reduce
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions import exprs as X

SPACE = ("bpm", *X.FEATURES)

#: Weights by genre, in the order of the space.
GENRE_WEIGHTS = {
    "techno": (0.20, 0.18, 0.10, 0.12, 0.20, 0.08, 0.07, 0.05), "house": (0.18, 0.12, 0.12, 0.08, 0.15, 0.15, 0.10, 0.10),
    "ambient": (0.05, 0.25, 0.20, 0.08, 0.05, 0.12, 0.05, 0.20), "dnb": (0.25, 0.12, 0.08, 0.15, 0.10, 0.10, 0.12, 0.08),
}

#: Typical tempi by genre.
TYPICAL_BPM = {"techno": 125.0, "house": 120.0, "ambient": 100.0, "dnb": 170.0, "unknown": 120.0}

#: Thresholds of the weight choice and the refinement.
LEAST_FOR_PCA, LEAST_FOR_EWKM, BOOTSTRAPS, MOST_CI, VARIANCE, MOST_TURNS = 40, 80, 200, 0.3, 0.90, 100
STRONG, WEAK = 0.5, 0.3

#: Rounds of drawing seeds, and draws of a round for each centre.
SEED_ROUNDS, OVERSAMPLING = 5, 2

#: Distinct vectors that are held as one matrix, at most: a pass over so few is shorter than a job.
IN_MEMORY = 1 << 16

#: Beyond memory, cells that bound the silhouette, step by step, and rows that are then measured at once.
CELLS, REFINED = (64, 512, 4096), 2048


def zscore(rows: DataFrame, columns: tuple[str, ...] = SPACE) -> DataFrame:
    """``z``: each column less its mean over its population deviation (1 where that is 0)."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scaled = [(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns]
    return rows.crossJoin(F.broadcast(stats)).withColumn("z", F.array(*scaled)).drop(*stats.columns)


def weighted(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``x``: z times the roots of the weights."""
    return rows.withColumn("x", F.array(*[F.get("z", F.lit(j)) * float(w) for j, w in enumerate(np.sqrt(weights))]))


#: Vectors of a block, at most; sums of more numbers meet in a shuffle, of fewer on the driver.
BLOCK_ROWS, MOST_SUMS = 1 << 14, 1 << 14

#: Full blocks that a task of a light pass has, about: such a pass over fewer is shorter than a task's start.
LIGHT_BLOCKS = 4

#: Genres that are clustered at once; of what is held in memory, one at a time is passed over.
AT_ONCE, _ONE_IN_MEMORY = 8, Lock()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors and weights as blocks of bytes, so that a pass reads matrices."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c, np.float64).tobytes()], pa.binary()) for c in (x, part.column("w").to_numpy(zero_copy_only=False))], ["x", "w"])


class Points:
    """A column of vectors to pass over again and again, equal ones as one with a weight.

    Up to ``IN_MEMORY`` distinct vectors they are held as one matrix here;
    beyond, every pass is a job over blocks of them. Either way a pass does the same.
    """

    def __init__(self, rows: DataFrame, column: str):
        self.rows = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").cast("double").alias("w")).persist()
        self.local, self.blocks, self.light, self.scale = None, None, None, None
        n = self.rows.count()
        if n <= IN_MEMORY:
            head = self.rows.toArrow().combine_chunks()
            v = head.column("v").combine_chunks()
            width = len(v[0]) if len(v) else 0
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), width)
            order = np.lexsort(x.T[::-1]) if width else np.arange(len(v))
            self.local = x[order], head.column("w").to_numpy()[order]
        else:
            self.blocks = self.rows.mapInArrow(_blocks, "x binary, w binary").rdd.map(tuple).persist()
            self.light = self.blocks.coalesce(-(-n // (LIGHT_BLOCKS * BLOCK_ROWS)))

    def __enter__(self) -> Points:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.rows.unpersist()
        if self.blocks is not None:
            self.blocks.unpersist()

    def times(self, scale: np.ndarray) -> Points:
        """The same vectors with their components times numbers other than 0; what is kept stays this one's."""
        out = copy(self)
        out.scale = scale if self.scale is None else self.scale * scale
        out.rows = self.rows.withColumn("v", F.array(*[F.get("v", F.lit(j)) * float(c) for j, c in enumerate(scale)]))
        out.local = None if self.local is None else (self.local[0] * scale, self.local[1])
        return out

    def each_block(self, work, light: bool = False):
        """What ``work`` (iterator of matrices and weights -> iterator) gives for all tasks' blocks, as an RDD; light work in fewer tasks."""
        scale = self.scale

        def task(blocks):
            def read():
                for x, w in blocks:
                    w = np.frombuffer(w)
                    x = np.frombuffer(x).reshape(len(w), -1)
                    yield (x if scale is None else x * scale), w

            return work(read())

        return (self.light if light else self.blocks).mapPartitions(task)

    def sums(self, work, size: int, light: bool = False) -> np.ndarray:
        """The sum over tasks of ``work`` (matrix, weights -> array of a fixed size)."""
        if self.local is not None:
            with _ONE_IN_MEMORY:
                return np.asarray(work(*self.local), float) if len(self.local[0]) else np.zeros(size)

        def whole(blocks):
            total = np.zeros(size)
            for x, w in blocks:
                total += work(x, w)
            return total

        if size <= MOST_SUMS:
            return sum(self.each_block(lambda blocks: [whole(blocks)], light).collect(), np.zeros(size))

        def parts(blocks):
            total = whole(blocks)
            for at in range(0, size, MOST_SUMS):
                part = total[at : at + MOST_SUMS]
                if part.any():
                    yield at, part

        found = np.zeros(size)
        for at, part in self.each_block(parts, light).reduceByKey(lambda a, b: a + b).collect():
            found[at : at + len(part)] = part
        return found

    def first_by(self, key, models: int) -> list[np.ndarray]:
        """For each model the row of the least key; ``key`` is (matrix, weights -> rows x models)."""
        least = lambda x, w: [(m, float(k[at]), x[at].tolist()) for m, k in enumerate(key(x, w).T) for at in [int(k.argmin())]]
        if self.local is not None:
            return [np.array([v]) for _, _, v in least(*self.local)]
        out = self.each_block(lambda blocks: (r for block in blocks for r in least(*block)), light=True).map(lambda r: (r[0], r[1:])).reduceByKey(min).collect()
        return [np.array([v]) for _, (_, v) in sorted(out)]

    def drawn(self, chance, models: int) -> list[np.ndarray]:
        """For each model the rows whose draw comes out; ``chance`` is (matrix, weights -> rows x models, true for those)."""
        if self.local is not None:
            x, _ = self.local
            return [x[hit] for hit in chance(*self.local).T]

        def hits(blocks):
            for x, w in blocks:
                for at, m in np.argwhere(chance(x, w)).tolist():
                    yield m, x[at].tolist()

        out = self.each_block(hits, light=True).collect()
        return [np.array(sorted(v for k, v in out if k == m)) for m in range(models)]


def covariance(points: Points, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population covariance) in one pass."""
    s = points.sums(lambda x, w: np.concatenate([[w.sum()], w @ x, (x.T @ (x * w[:, None])).ravel()]), 1 + d + d * d)
    n = max(s[0], 1)
    mean = s[1 : 1 + d] / n
    return int(s[0]), mean, s[1 + d :].reshape(d, d) / n - np.outer(mean, mean)


def communalities(cov: np.ndarray, n: int, keep: int | None = None, target: float = VARIANCE) -> tuple[np.ndarray, int]:
    """Feature weights of the components that explain the target share."""
    values, vectors = np.linalg.eigh(cov * n / max(n - 1, 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    share = values / values.sum() if values.sum() > 0 else np.full(len(values), 1 / len(values))
    k = keep or min(int(np.searchsorted(np.cumsum(share), target)) + 1, len(values))
    weight = ((vectors[:, :k] ** 2 * values[:k]) * share[:k]).sum(axis=1)
    return (weight / weight.sum() if weight.sum() > 0 else np.full(len(weight), 1 / len(weight))), k


def pca_weights(rows: DataFrame, column: str = "z", d: int = len(SPACE), boots: int = BOOTSTRAPS, seed: int = 42) -> tuple[np.ndarray, float]:
    """Weights and the width of their widest bootstrap interval.

    The resamples are Poisson counts drawn per distinct row from its hash, of a
    mean of as many as are equal, so all covariances come from one pass, equal
    rows are drawn each for itself, and reruns agree.
    """
    with Points(rows, column) as points:
        return _pca_weights(points, d, boots, seed)


#: Rows of a group of equal ones whose resampled numbers are drawn at once, at most.
DRAWN_AT_ONCE = 1 << 16


@lru_cache(maxsize=32)
def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """(first, chances): the chance that a Poisson number is at most first, first + 1 and so on."""
    reach = 20 + int(12 * np.sqrt(mean))
    first = max(0, mean - reach)
    n = np.arange(1, mean + reach + 1)
    log = np.concatenate([[0.0], np.cumsum(np.log(mean / n))]) - mean
    return first, np.minimum(np.cumsum(np.exp(log[first:])), 1.0)


def value_hash(x: np.ndarray) -> np.ndarray:
    """A hash of each row's values."""
    out = np.zeros(len(x), np.uint64)
    for column in np.ascontiguousarray(x + 0.0, np.float64).view(np.uint64).T:
        out = _scramble(out * np.uint64(3) + column + np.uint64(1))
    return out


def draws(hashes: np.ndarray, turn: int) -> np.ndarray:
    """A number in (0, 1) for each hash, another one for another turn."""
    salt = _scramble(np.array([turn % (1 << 64)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
    return ((_scramble(hashes ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def row_draws(x: np.ndarray, w: np.ndarray, boots: int, seed: int) -> np.ndarray:
    """How often each resample takes the rows of each group of equal ones, by a hash of the row."""
    hashes = value_hash(x)
    out = np.zeros((boots, len(x)))
    left, bit = w.astype(np.int64), 0
    while left.any():  # a Poisson number is the sum of those of the binary parts of its mean
        size = min(1 << bit, DRAWN_AT_ONCE)
        times = np.where(left & 1, 1, 0) << max(0, bit - 16)
        first, chances = _poisson(size)
        for turn in range(int(times.max())):
            some = np.flatnonzero(times > turn)
            mine = hashes[some]
            for b in range(boots):
                out[b, some] += first + np.minimum(np.searchsorted(chances, draws(mine, (seed << 40) + (bit << 32) + (turn << 16) + b)), len(chances) - 1)
        left, bit = left >> 1, bit + 1
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pca_weights(points: Points, d: int, boots: int, seed: int) -> tuple[np.ndarray, float]:
    n, _, cov = covariance(points, d)
    weights, k = communalities(cov, n)
    size = 1 + d + d * d

    def work(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        counts = row_draws(x, w, boots, seed)
        outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return np.concatenate([counts.sum(axis=1, keepdims=True), counts @ x, counts @ outer], axis=1).ravel()

    boot = points.sums(work, boots * size).reshape(boots, size)
    found = []
    for b in boot:
        m = max(b[0], 1)
        mean = b[1 : 1 + d] / m
        found.append(communalities(b[1 + d :].reshape(d, d) / m - np.outer(mean, mean), int(m), k)[0])
    width = float(np.max(np.percentile(found, 97.5, axis=0) - np.percentile(found, 2.5, axis=0)))
    return weights, width


def choose_weights(rows: DataFrame, n: int, genre: str | None = None, overrides: np.ndarray | None = None, points: Points | None = None) -> tuple[np.ndarray, str]:
    """Overrides, else stable PCA weights, else the genre's, else all equal. ``points`` are the rows' z, where there are some already."""
    if overrides is not None:
        return overrides, "user"
    if n >= LEAST_FOR_PCA:
        weights, width = pca_weights(rows) if points is None else _pca_weights(points, len(SPACE), BOOTSTRAPS, 42)
        if width <= MOST_CI:
            return weights, "pca"
    if genre is not None:
        raw = np.array(GENRE_WEIGHTS[genre.lower()])
        return raw / raw.sum(), "heuristic"
    return np.full(len(SPACE), 1 / len(SPACE)), "uniform"


def apply_overrides(base: np.ndarray, overrides: dict[str, float]) -> np.ndarray:
    """The base weights with some replaced; what is replaced is not normalised again."""
    unknown = set(overrides) - set(SPACE)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    out = base / base.sum() if base.sum() > 0 else np.full(len(base), 1 / len(base))
    for name, w in overrides.items():
        out[SPACE.index(name)] = w
    return out


def timbre_overrides(slider: float) -> dict[str, float]:
    """The weights that the slider for alike timbre sets, from 0 (none) to 1; brightness gets the value itself."""
    if not 0 <= slider <= 1:
        raise ValueError(f"the slider goes from 0 to 1, not {slider}")
    return {"brightness": 1.0 + 2.0 * slider} if slider > 0 else {}


def slider_weights(rows: DataFrame, slider: Column) -> DataFrame:
    """Each row once for every feature: ``feature`` and its ``weight``, equal ones under the row's slider for alike timbre."""
    even = apply_overrides(np.full(len(SPACE), 1 / len(SPACE)), {})
    cells = [F.struct(F.lit(c).alias("feature"), (F.when(slider > 0, 1.0 + 2.0 * slider).otherwise(float(w)) if c == "brightness" else F.lit(float(w))).alias("weight")) for c, w in zip(SPACE, even, strict=True)]
    return rows.select("*", F.inline(F.array(*cells)))


def valid_weights(weights: dict[str, float | None]) -> bool:
    """All features, none negative, in sum 1."""
    values = [weights.get(c) for c in SPACE]
    return all(v is not None and v >= 0 for v in values) and bool(np.isclose(sum(values), 1.0, atol=1e-6))


@dataclass
class KMeans:
    centers: np.ndarray
    inertia: float


def seeds(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on candidates that stand for so many rows each."""
    p = weights / weights.sum()
    chosen = [candidates[rng.choice(len(candidates), p=p)]]
    gap = ((candidates - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        heavy = gap * weights
        chosen.append(candidates[rng.choice(len(candidates), p=heavy / heavy.sum() if heavy.sum() > 0 else p)])
        gap = np.minimum(gap, ((candidates - chosen[-1]) ** 2).sum(axis=1))
    return np.stack(chosen)


def _gaps(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, squared distance) of the nearest centre, 0 where it is the row itself."""
    gap = distances(x, centers)
    at = gap.argmin(axis=1)
    least = gap[np.arange(len(x)), at]
    return at, np.where(least <= 1e-12 * ((x * x).sum(axis=1) + 1e-300), 0.0, least)


def drawn_seeds(points: Points, ks: list[int], restarts: int, seed: int) -> list[np.ndarray]:
    """First centres for each number of clusters and restart, from all rows."""
    rng = np.random.default_rng(seed)
    turn = iter(range(seed << 20, (seed << 20) + (1 << 20)))
    firsts = [next(turn) for _ in range(restarts)]

    def waiting(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        hashes = value_hash(x)
        return np.stack([-np.log(draws(hashes, t)) / w for t in firsts], axis=1)

    sets = points.first_by(waiting, restarts)
    wanted = OVERSAMPLING * max(ks)
    for _ in range(SEED_ROUNDS):
        now = list(sets)
        cost = points.sums(lambda x, w, now=now: np.array([(w * _gaps(x, c)[1]).sum() for c in now]), restarts, light=True)
        if not cost.any():
            break
        turns = [next(turn) for _ in range(restarts)]

        def comes(x: np.ndarray, w: np.ndarray, now=now, cost=cost, turns=turns) -> np.ndarray:
            hashes, out = value_hash(x), []
            for c, whole, t in zip(now, cost, turns, strict=True):
                p = np.minimum(wanted * _gaps(x, c)[1] / whole, 1.0) if whole > 0 else np.zeros(len(x))
                out.append(draws(hashes, t) < -np.expm1(w * np.log1p(-np.minimum(p, 1 - 1e-16))))
            return np.stack(out, axis=1)

        sets = [np.concatenate([c, new]) if len(new) else c for c, new in zip(now, points.drawn(comes, restarts), strict=True)]
    at = np.cumsum([0, *map(len, sets)])
    stands = points.sums(lambda x, w: np.concatenate([np.bincount(_gaps(x, c)[0], weights=w, minlength=len(c)) for c in sets]), int(at[-1]), light=True)
    return [seeds(c, np.maximum(stands[a : a + len(c)], 1e-9), k, rng) for k in ks for c, a in zip(sets, at, strict=False)]


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1), 0)


def fit(rows: DataFrame, ks: list[int], *, column: str = "x", restarts: int = 10, turns: int = 60, seed: int = 42) -> dict[int, KMeans]:
    """The best of some restarts for each number of clusters."""
    with Points(rows, column) as points:
        return _fit(points, ks, restarts, turns, seed)


def _fit(points: Points, ks: list[int], restarts: int, turns: int, seed: int) -> dict[int, KMeans]:
    models = drawn_seeds(points, ks, restarts, seed)
    d = models[0].shape[1]
    at = np.cumsum([0, *(len(m) * (d + 1) + 1 for m in models)])

    for _ in range(turns):
        now = list(models)

        def work(x: np.ndarray, w: np.ndarray, now=now) -> np.ndarray:
            out = []
            for centers in now:
                gap = distances(x, centers)
                label = gap.argmin(axis=1)
                count = np.bincount(label, weights=w, minlength=len(centers))
                total = np.stack([np.bincount(label, weights=w * x[:, j], minlength=len(centers)) for j in range(x.shape[1])], axis=1)
                out += [total.ravel(), count, [(w * gap.min(axis=1)).sum()]]
            return np.concatenate(out)

        s = points.sums(work, int(at[-1]), light=True)
        still, inertia = True, []
        for i, centers in enumerate(now):
            part = s[at[i] : at[i + 1]]
            total, count = part[: len(centers) * d].reshape(-1, d), part[len(centers) * d : -1]
            moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
            still &= bool(np.allclose(moved, centers, atol=1e-7))
            models[i] = moved
            inertia.append(part[-1])
        if still:
            break
    best: dict[int, KMeans] = {}
    for i, k in enumerate(k for k in ks for _ in range(restarts)):
        if k not in best or inertia[i] < best[k].inertia:
            best[k] = KMeans(models[i], float(inertia[i]))
    return best


def assign(rows: DataFrame, centers: np.ndarray, column: str = "x", weights: np.ndarray | None = None) -> DataFrame:
    """``label``: the nearest centre, the first of equals; with weights, of weighted distance for each centre."""
    cells = F.array(*[F.struct(sum((float(1.0 if weights is None else weights[k, j]) * (F.get(column, F.lit(j)) - float(c)) ** 2 for j, c in enumerate(center)), F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, center in enumerate(centers)])
    return rows.withColumn("label", F.array_min(cells)["k"])


def _labels(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    return np.stack([distances(x, m).argmin(axis=1) for m in models], axis=1)


def _hot(labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One column for each cluster of each model."""
    out = np.zeros((len(labels), int(starts[-1])))
    for m, a in enumerate(starts[:-1]):
        out[np.arange(len(labels)), a + labels[:, m]] = 1
    return out


def _row_scores(low: np.ndarray, high: np.ndarray, own: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x models) least and greatest silhouettes, from bounds of the sums of distances to each cluster."""
    out = []
    for least in (True, False):
        mates, others = (high, low) if least else (low, high)
        scores = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            mine = own[:, a:b] > 0
            size = (mine * counts[a:b]).sum(axis=1)
            inner = (mates[:, a:b] * mine).sum(axis=1) / np.maximum(size - 1, 1)
            outer = np.where(mine | (counts[a:b] == 0), np.inf, others[:, a:b] / np.maximum(counts[a:b], 1)).min(axis=1)
            top = np.maximum(np.maximum(inner, np.where(np.isfinite(outer), outer, 0)), 1e-300)
            scores.append(np.where((size > 1) & np.isfinite(outer), (np.where(np.isfinite(outer), outer, 0) - inner) / top, 0.0))
        out.append(np.stack(scores, axis=1))
    return out[0], out[1]


class Cells:
    """A tree of cells, each cut at the mean of its widest dimension."""

    def __init__(self, d: int):
        self.d = d
        self.dim, self.cut, self.kids = np.array([-1]), np.array([0.0]), np.array([[0, 0]])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(self.dim[at] >= 0)
            if not len(open_):
                return at
            node = at[open_]
            at[open_] = self.kids[node, (x[open_, self.dim[node]] > self.cut[node]).astype(int)]

    def grow(self, points: Points, most: int) -> None:
        """Cuts every cell that has different rows, until there are so many."""
        while int((self.dim < 0).sum()) < most:
            nodes, d = len(self.dim), self.d

            def work(x: np.ndarray, w: np.ndarray) -> np.ndarray:
                at = self.leaf(x)
                cells = [np.bincount(at, weights=v, minlength=nodes) for v in (w, *(w * c for c in x.T), *(w * c * c for c in x.T))]
                return np.stack(cells, axis=1).ravel()

            s = points.sums(work, nodes * (1 + 2 * d)).reshape(nodes, -1)
            n = np.maximum(s[:, :1], 1)
            mean = s[:, 1 : 1 + d] / n
            wide = s[:, 1 + d :] / n - mean**2
            split = np.flatnonzero((self.dim < 0) & (wide.max(axis=1) > 1e-12 * np.maximum((mean**2).max(axis=1), 1e-12)))
            if not len(split):
                return
            self.dim[split] = wide[split].argmax(axis=1)
            self.cut[split] = mean[split, self.dim[split]]
            self.kids[split] = nodes + np.arange(2 * len(split)).reshape(-1, 2)
            more = 2 * len(split)
            self.dim, self.cut = np.append(self.dim, np.full(more, -1)), np.append(self.cut, np.zeros(more))
            self.kids = np.concatenate([self.kids, np.zeros((more, 2), int)])


class Bounds:
    """Bounds of every row's silhouette from the cells of each cluster.

    The mean distance of a row to a cell's rows is at least its distance to
    their centre (distance is convex) and at most the root of its square and
    the cell's variance (the root is concave).
    """

    def __init__(self, points: Points, models: list[np.ndarray], starts: np.ndarray, counts: np.ndarray, cells: Cells):
        self.models, self.starts, self.counts = models, starts, counts
        nodes, width, d = len(cells.dim), int(starts[-1]), cells.d

        def work(x: np.ndarray, w: np.ndarray) -> np.ndarray:
            at, labels = cells.leaf(x), _labels(x, models)
            out = np.zeros((nodes * width, 2 + d))
            for m, a in enumerate(starts[:-1]):
                spot = at * width + a + labels[:, m]
                for j, v in enumerate((w, w * (x * x).sum(axis=1), *(w * c for c in x.T))):
                    out[:, j] += np.bincount(spot, weights=v, minlength=len(out))
            return out.ravel()

        s = points.sums(work, nodes * width * (2 + d)).reshape(nodes * width, -1)
        used = np.flatnonzero(s[:, 0] > 0)
        self.n, self.cluster = s[used, 0], used % width
        self.centre = s[used, 2:] / self.n[:, None]
        self.spread = np.maximum(s[used, 1] / self.n - (self.centre**2).sum(axis=1), 0)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _hot(_labels(x, self.models), self.starts)
        by_cluster = np.zeros((len(self.n), int(self.starts[-1])))
        by_cluster[np.arange(len(self.n)), self.cluster] = self.n
        parts, step = [], max(1, (1 << 22) // max(len(self.n), 1))
        for at in range(0, len(x), step):
            gap = distances(x[at : at + step], self.centre)
            low, high = np.sqrt(gap) @ by_cluster, np.sqrt(gap + self.spread) @ by_cluster
            parts.append(_row_scores(low, high, own[at : at + step], self.counts, self.starts))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def silhouettes(points: Points, models: list[np.ndarray], settled=lambda low, high: False) -> tuple[list[float], list[float]]:
    """Bounds of the mean Euclidean silhouette of all rows under each model's labels.

    In memory, they are equal. Beyond, cells bound every row's score, finer
    ones where ``settled`` (least, greatest -> bool) says that the bounds don't
    do; and then rows are measured against all rows, those of the widest bounds
    first, until they do or all are measured.
    """
    if not models:
        return [], []
    starts = np.cumsum([0, *map(len, models)])
    width = int(starts[-1])
    counts = points.sums(lambda x, w: w @ _hot(_labels(x, models), starts), width)
    n = counts[starts[0] : starts[1]].sum()
    several = np.array([(counts[a:b] > 0).sum() > 1 for a, b in zip(starts[:-1], starts[1:], strict=True)])
    mean = lambda total: np.where(several, total / max(n, 1), -1.0).tolist()
    if n == 0:
        return mean(np.full(len(models), -1.0)), mean(np.full(len(models), -1.0))
    if points.local is not None:
        x, w = points.local
        own, total, step = _hot(_labels(x, models), starts), np.zeros(len(models)), max(1, (1 << 24) // len(x))
        for at in range(0, len(x), step):
            sums = np.sqrt(distances(x[at : at + step], x)) @ (own * w[:, None])
            total += w[at : at + step] @ _row_scores(sums, sums, own[at : at + step], counts, starts)[0]
        return mean(total), mean(total)
    cells = Cells(models[0].shape[1])
    for most in CELLS:
        cells.grow(points, most)
        bounds = Bounds(points, models, starts, counts, cells)
        low, high = points.sums(lambda x, w: np.concatenate([w @ b for b in bounds.of(x)]), 2 * len(models)).reshape(2, -1)
        if settled(mean(low), mean(high)):
            return mean(low), mean(high)
    return _refined(points, models, starts, counts, bounds, low, high, mean, settled)


def _refined(points: Points, models, starts, counts, bounds: Bounds, low: np.ndarray, high: np.ndarray, mean, settled) -> tuple[list[float], list[float]]:
    """Bounds after so many rows as it takes are measured against all rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                least, most = bounds.of(x)
                gap = batch["w"].to_numpy() * (most - least).max(axis=1)
                yield pd.DataFrame({"v": batch["v"], "w": batch["w"], "low": least.tolist(), "high": most.tolist(), "gap": gap, "h": value_hash(x).view(np.int64)})

    rows = points.rows.mapInPandas(each, "v array<double>, w double, low array<double>, high array<double>, gap double, h long").persist()
    last = None
    while not settled(mean(low), mean(high)):
        rest = rows if last is None else rows.where((F.col("gap") < last.gap) | ((F.col("gap") == last.gap) & (F.col("h") < last.h)))
        found = rest.orderBy(F.desc("gap"), F.desc("h")).limit(REFINED).collect()
        if not found:
            break
        asked, weight, last = np.array([r.v for r in found]), np.array([r.w for r in found]), found[-1]
        sums = points.sums(lambda x, w, asked=asked: (np.sqrt(distances(asked, x)) @ (_hot(_labels(x, models), starts) * w[:, None])).ravel(), len(asked) * int(starts[-1])).reshape(len(asked), -1)
        exact = weight @ _row_scores(sums, sums, _hot(_labels(asked, models), starts), counts, starts)[0]
        low = low + exact - weight @ np.array([r.low for r in found])
        high = high + exact - weight @ np.array([r.high for r in found])
    rows.unpersist()
    return mean(low), mean(high)


def constraint(n: int, duration: float, least: int, most: int, target_tracks: int | None, target_duration: float | None) -> int | None:
    """The number of clusters that the wanted sizes ask for."""
    tracks = max(least, min(n // target_tracks, most)) if target_tracks else None
    time = max(least, min(int(duration / target_duration), most)) if target_duration else None
    return int((tracks + time) / 2) if tracks and time else tracks or time


def choose_k(rows: DataFrame, n: int, *, column: str = "x", least: int = 2, most: int = 10, wanted: int | None = None, restarts: int = 10) -> tuple[int, dict[int, KMeans]]:
    """The number of clusters by elbow and silhouette, held to what is wanted within two.

    An empty range of counts gives the least.
    """
    ks = list(range(least, min(most + 1, n)))
    if not ks:
        return least, {}
    with Points(rows, column) as points:
        return _choose_k(points, ks, least, wanted, restarts)


def _choose_k(points: Points, ks: list[int], least: int, wanted: int | None, restarts: int) -> tuple[int, dict[int, KMeans]]:
    models = _fit(points, ks, restarts, 60, 42)
    drops = np.abs(np.diff([models[k].inertia for k in ks]))
    elbow = least + int(np.argmax(drops)) if len(drops) else least
    single = [-1.0] * (ks[0] < 2)
    choices = lambda low, high: _choices(ks, single + list(low), single + list(high), elbow)
    low, high = silhouettes(points, [models[k].centers for k in ks if k > 1], lambda low, high: len(choices(low, high)) == 1)
    k = min(choices(low, high))
    return (wanted if wanted and abs(wanted - k) <= 2 else k), models


def _choices(ks: list[int], low: list[float], high: list[float], elbow: int) -> set[int]:
    """The numbers of clusters that scores between these bounds may choose."""
    top = max(low)
    best = [ks[int(np.argmax(low))]] if low == high else [k for k, h in zip(ks, high, strict=True) if h >= top]
    out: set[int] = set()
    if max(high) >= STRONG:
        out |= set(best)
    if top < WEAK:
        out.add(elbow)
    if top < STRONG and max(high) >= WEAK:
        out |= {round((k + elbow) / 2) for k in best}
    return out


def ewkm(rows: DataFrame, centers: np.ndarray, *, column: str = "z", gamma: float = 1.0, turns: int = MOST_TURNS, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-weighted k-means: centres and weights that the labels are made with, and the weights after them.

    It ends as soon as a turn labels all rows as the one before did; the labels
    before the first are those of ``centers`` under the weights ``start``.
    """
    with Points(rows, column) as points:
        return _ewkm(points, centers, gamma, turns, start)


def _ewkm(points: Points, centers: np.ndarray, gamma: float, turns: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, d = centers.shape
    weights = np.full((k, d), 1 / d)
    before = centers, np.tile(start, (k, 1)) if start is not None else None
    for _ in range(turns):

        def work(x: np.ndarray, w: np.ndarray, centers=centers, weights=weights, before=before) -> np.ndarray:
            nearest = lambda c, v: (v[None] * (x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            label = nearest(centers, weights)
            changed = len(x) if before[1] is None else (label != nearest(*before)).sum()
            hot = np.eye(k)[label] * w[:, None]
            return np.concatenate([[changed], hot.sum(axis=0), (hot.T @ x).ravel(), (hot.T @ (x * x)).ravel()])

        s = points.sums(work, 1 + k + 2 * k * d, light=True)
        still, s = s[0] == 0, s[1:]
        count, total, squares = s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(k, d)
        full = count[:, None] > 0
        n = np.maximum(count, 1)[:, None]
        moved = np.where(full, total / n, centers)
        spread = np.maximum(squares / n - 2 * moved * total / n + moved**2, 0)
        log = -spread / gamma
        soft = np.exp(log - log.max(axis=1, keepdims=True))
        fresh = np.where(full, soft / soft.sum(axis=1, keepdims=True), 1 / d)
        before = centers, weights
        centers, weights = moved, fresh
        if still:
            break
    return *before, weights


@dataclass
class Clustering:
    """labelled: the rows with cluster_id; importance: per cluster, by feature."""

    labelled: DataFrame
    centers: np.ndarray
    importance: np.ndarray
    source: str


def cluster(known: DataFrame, *, k: int | None = None, genre: str | None = None, overrides: dict[str, float] | None = None, use_ewkm: bool = True, dedup: str = "reference", least: int = 2, most: int = 10,
            target_tracks: int | None = None, target_duration: float | None = None, restarts: int = 10, bpm_scale: DataFrame | None = None, extra: DataFrame | None = None) -> Clustering:
    """Feature clusters of the tracks with a tempo.

    With ``dedup="reference"`` a track stays only where its label agrees with
    the nearest centre of the first fit, as refinement may relabel it; with
    "keep" all stay. ``bpm_scale`` (pos, factor) stretches the tempo axis after
    scaling; ``extra`` (pos, block array<double>) adds a block of coordinates
    at 0.3 of the weight, and then nothing is refined.
    """
    rows = zscore(known.where("bpm IS NOT NULL").select("pos", *SPACE))
    if bpm_scale is not None:
        rows = rows.join(bpm_scale, "pos", "left").withColumn("z", F.transform("z", lambda z, j: F.when(j == 0, z * F.coalesce("factor", F.lit(1.0))).otherwise(z))).drop("factor")
    rows = rows.persist()
    n = rows.count()
    given = apply_overrides(np.full(len(SPACE), 1 / len(SPACE)), overrides) if overrides else None
    shared = Points(rows, "z")
    weights, source = choose_weights(rows, n, genre, given, shared)
    placed = weighted(rows, weights)
    if extra is not None:
        placed = placed.join(extra, "pos").withColumn("x", F.concat(F.transform("x", lambda x: x * 0.70), F.transform("block", lambda x: x * 0.30))).drop("block")
        source = "block_pca"
    placed = placed.persist()
    # distinct z are distinct x where no weight is 0
    points = shared.times(np.sqrt(weights)) if extra is None and (weights > 0).all() else Points(placed, "x")
    duration = known.agg(F.sum(F.coalesce("duration", F.lit(0.0)))).first()[0] or 0.0
    if k is None:
        ks = list(range(least, min(most + 1, n)))
        k, models = _choose_k(points, ks, least, constraint(n, duration, least, most, target_tracks, target_duration), restarts) if ks else (least, {})
    else:
        k, models = max(least, min(k, n)), {}
    model = models.get(k) or _fit(points, [k], restarts, 60, 42)[k]
    first = assign(placed, model.centers)
    spread = model.centers[:, : len(SPACE)].var(axis=0)
    importance = np.tile(spread / spread.sum() if spread.sum() > 0 else np.full(len(SPACE), 1 / len(SPACE)), (k, 1))
    labelled = first.withColumn("cluster_id", F.col("label").cast("string"))
    if use_ewkm and extra is None and n >= LEAST_FOR_EWKM:
        centers, used, importance = _ewkm(shared, model.centers / np.sqrt(np.maximum(weights, 1e-12)), 1.0, MOST_TURNS, weights)
        labelled = assign(first.withColumnRenamed("label", "nearest"), centers, "z", used).withColumn("cluster_id", F.col("label").cast("string"))
        if dedup == "reference":
            labelled = labelled.where("label = nearest")
    points.close()
    shared.close()
    return Clustering(labelled.select("pos", "cluster_id", "z", "x"), model.centers, importance, source)


def per_genre(known: DataFrame, **options) -> DataFrame:
    """(pos, cluster_id): clusters inside each genre; genres of fewer tracks than clusters are one.

    ``known`` has ``resolved``, the genre of each track; genres are few. Those
    that may not fit in memory are clustered at the same time, as a round of one
    leaves most tasks' places free; the others one by one, to spare the driver's memory.
    """
    least = options.get("least", 2)
    known = known.select("pos", "resolved", "duration", *SPACE).persist()
    genres = sorted(known.where("bpm IS NOT NULL").groupBy("resolved").count().collect(), key=lambda r: r.resolved)

    def part(r) -> DataFrame:
        rows = known.where(F.col("resolved") == r.resolved)
        if r["count"] < max(least, 3):
            return rows.where("bpm IS NOT NULL").select("pos", F.lit("0").alias("cluster_id"))
        return cluster(rows, genre=None if r.resolved == "unknown" else r.resolved, **options).labelled.select("pos", "cluster_id")

    if not genres:
        return None
    with ThreadPoolExecutor(AT_ONCE) as pool:
        large = {r.resolved: pool.submit(inheritable_thread_target(known.sparkSession)(part), r) for r in genres if r["count"] > IN_MEMORY}
        small = {r.resolved: part(r) for r in genres if r.resolved not in large}
        parts = {g: p.result() for g, p in large.items()} | small
    named = [parts[r.resolved].select("pos", F.concat(F.lit(f"{r.resolved}_"), "cluster_id").alias("cluster_id")) for r in genres]
    return reduce(DataFrame.unionByName, named)


def genre_scale(known: DataFrame) -> DataFrame:
    """(pos, factor): 120 by the genre's typical tempo."""
    return known.select("pos", (F.lit(120.0) / X.lookup(F.col("resolved"), TYPICAL_BPM, 120.0)).alias("factor"))


def embedding_block(vectors: DataFrame, components: int = 12) -> DataFrame:
    """(pos, block): scaled principal components of the embeddings."""
    rows = vectors.select("pos", F.col("embedding").cast("array<double>").alias("v"))
    d = len(rows.first().v)
    with Points(rows, "v") as points:
        _, mean, cov = covariance(points, d)
    values, vectors_ = np.linalg.eigh(cov)
    axes = vectors_[:, ::-1][:, : min(components, d)].T
    scale = np.sqrt(np.maximum(values[::-1][: len(axes)], 1e-300))
    cells = [F.aggregate(F.zip_with(F.col("v"), F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(float(-(axis @ mean))), lambda s, x: s + x) / float(s) for axis, s in zip(axes, scale, strict=True)]
    return rows.select("pos", F.array(*cells).alias("block"))


#: Labels of a mood block, at most: each is a coordinate of every track.
MOST_LABELS = 4096


def mood_block(moods: DataFrame, tracks: DataFrame) -> DataFrame:
    """(pos, block): for each track its scaled probabilities of all mood labels, in the labels' order.

    moods: pos, label, prob, one row for each label that a track has; what it
    lacks counts as 0, and of one label twice the greater counts. Labels' means
    and deviations come from the rows that are there and the number of
    tracks, so no column is made for a label; a track's few labels meet all
    labels' values in one array. Labels that all tracks have alike are 0.
    Without labels the block is empty.
    """
    sparse = moods.join(tracks.select("pos"), "pos", "left_semi").where("label IS NOT NULL AND prob IS NOT NULL").groupBy("pos", "label").agg(F.max("prob").cast("double").alias("prob"))
    n = tracks.count()
    labels = sparse.groupBy("label").agg((F.sum("prob") / n).alias("mean"), (F.sum(F.col("prob") * F.col("prob")) / n).alias("square")).orderBy("label").limit(MOST_LABELS + 1).toPandas()
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels of moods")
    mean = labels["mean"].to_numpy(float)
    wide = labels["square"].to_numpy(float) - mean**2
    scale = np.sqrt(np.where(wide > 1e-12 * np.maximum(labels["square"].to_numpy(float), 1e-300), wide, np.inf))
    own = sparse.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("label", "prob"))).alias("own"))
    table = tracks.sparkSession.createDataFrame([([(str(c), float(m), float(d)) for c, m, d in zip(labels["label"], mean, scale, strict=True)],)], "labels array<struct<label:string,mean:double,scale:double>>")
    rows = tracks.select("pos").join(own, "pos", "left").crossJoin(F.broadcast(table))
    value = lambda c: (F.coalesce(F.element_at(F.coalesce("own", F.create_map().cast("map<string,double>")), c["label"]), F.lit(0.0)) - c["mean"]) / c["scale"]
    return rows.select("pos", F.transform("labels", value).alias("block"))


def semantic_block(vectors: DataFrame, moods: DataFrame, components: int = 12) -> DataFrame:
    """(pos, block): the embedding's scaled components, then the scaled moods."""
    parts = embedding_block(vectors, components)
    more = mood_block(moods, vectors).withColumnRenamed("block", "moods")
    return parts.join(more, "pos").select("pos", F.concat("block", "moods").alias("block"))
