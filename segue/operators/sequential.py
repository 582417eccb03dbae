"""Operators whose next choice depends on all earlier ones.

They run once per cluster, in parallel over clusters; a cluster is a playlist's
worth of tracks. Naming runs over cluster profiles only.
"""

from __future__ import annotations

import random
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions import exprs as X

from . import sequencing
from .neartree import NearTree

ORDER = "cluster_id string, pos long, seq int"


def _number_letter(key: str | None) -> tuple[int, str] | None:
    if not key or key[-1] not in "AB" or not key[:-1].isdigit():
        return None
    return (int(key[:-1]), key[-1]) if 1 <= int(key[:-1]) <= 12 else None


def key_score(a: str | None, b: str | None) -> int:
    x, y = _number_letter(a), _number_letter(b)
    if x is None or y is None:
        return 0
    gap, same = abs(x[0] - y[0]), x[1] == y[1]
    if (same and gap in (0, 1, 11)) or (not same and gap in (3, 9)):
        return 2
    return int(gap == 0)


class _Shelf:
    """Tracks by energy, then place; the nearest that is left is found without passing over those taken."""

    def __init__(self, places: list[int], rms: list[float]):
        self.places = sorted(places, key=lambda i: (rms[i], i))
        self.rms = [rms[i] for i in self.places]
        self.at = {i: k for k, i in enumerate(self.places)}
        self.up, self.down = list(range(len(places) + 1)), list(range(len(places) + 1))

    @staticmethod
    def _root(of: list[int], k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    def take(self, i: int) -> None:
        k = self.at[i]
        self.up[k], self.down[k + 1] = k + 1, k

    def nearest(self, x: float) -> tuple[float, int] | None:
        """(gap, place); of equal gaps the first place."""
        split, found = bisect_left(self.rms, x), []
        above = self._root(self.up, split)
        if above < len(self.rms):
            found.append((abs(x - self.rms[above]), self.places[above]))
        below = self._root(self.down, split) - 1
        if below >= 0:
            k = self._root(self.up, bisect_left(self.rms, self.rms[below]))
            found.append((abs(x - self.rms[k]), self.places[k]))
        return min(found, default=None)


def harmonic(known: DataFrame) -> DataFrame:
    """From the loudest track on, the best matching key next, then the nearest energy.

    The tracks that are left stand by key in order of energy, so a step asks
    each key once, in the logarithm of its tracks.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        keys, rms = rows.camelot_key.tolist(), rows.rms_energy.tolist()
        by_key: dict[str | None, list[int]] = {}
        for i, k in enumerate(keys):
            by_key.setdefault(k if _number_letter(k) else None, []).append(i)
        shelves = {k: _Shelf(places, rms) for k, places in by_key.items()}
        ranks = {a: sorted((-key_score(a, b), str(b), b) for b in shelves) for a in shelves}
        at, path = int(np.argmax(rms)), []
        while True:
            path.append(at)
            home = keys[at] if keys[at] in shelves else None
            shelves[home].take(at)
            best = None
            for score, _, key in ranks[home]:
                if best is not None and score > best[0]:
                    break
                near = shelves[key].nearest(rms[at])
                if near is not None and (best is None or near < best[1]):
                    best = score, near
            if best is None:
                break
            at = best[1][1]
        out = rows.iloc[path]
        return pd.DataFrame({"cluster_id": out.cluster_id.to_numpy(), "pos": out.pos.to_numpy(), "seq": np.arange(1, len(out) + 1, dtype=np.int32)})

    return known.select("cluster_id", "pos", "camelot_key", "rms_energy").groupBy("cluster_id").applyInPandas(work, ORDER)


def timbre(known: DataFrame) -> DataFrame:
    """From the most varied timbre on, the nearest next.

    The tracks that are left stand in a k-d tree, so a step looks at those near
    by and not at all of the cluster.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        tree = NearTree(rows[list(X.TIMBRE)].to_numpy())
        at, path = int(rows.mfcc_variance.argmax()), []
        while at is not None:
            path.append(at)
            tree.take(at)
            at = tree.nearest(at)
        out = rows.iloc[path]
        return pd.DataFrame({"cluster_id": out.cluster_id.to_numpy(), "pos": out.pos.to_numpy(), "seq": np.arange(1, len(out) + 1, dtype=np.int32)})

    return known.select("cluster_id", "pos", *X.TIMBRE).groupBy("cluster_id").applyInPandas(work, ORDER)


#: Fixed: what the choice of intros asks for.
INTROS = {"short": "intro_asc", "long": "intro_desc"}


def arranged(known: DataFrame, *, strategy: str | None = None, intro: str | None = None, harmonic_order: bool = False) -> DataFrame:
    """(cluster_id, pos, seq) under several wishes at once: matching keys go before a choice of intros (short or long), that before a strategy.

    Without any wish, and for a strategy that isn't known, tracks keep their positions.
    """
    if harmonic_order:
        return harmonic(known)
    if intro is not None and intro not in INTROS:
        raise ValueError(f"intros are {' or '.join(INTROS)} first, not {intro!r}")
    wish = INTROS[intro] if intro is not None else strategy
    return sequencing.sequence(known, wish if wish in sequencing.STRATEGIES else "fixed").select("cluster_id", "pos", "seq")


def mix_scores(bpm: np.ndarray, keys: list, rms: np.ndarray, bright: np.ndarray, i: int) -> np.ndarray:
    at = _number_letter(keys[i])

    def fits(key) -> float:
        other = _number_letter(key)
        if at is None or other is None:
            return 0.0
        gap, same = abs(at[0] - other[0]), at[1] == other[1]
        return float(gap == 0 or (same and gap in (1, 11)) or (not same and gap in (3, 9)))

    match = np.array([fits(k) for k in keys])
    score = 0.3 * np.maximum(0.0, 1 - np.abs(bpm - bpm[i]) / 20) + 0.3 * match + 0.25 * (1 - np.abs(rms - rms[i])) + 0.15 * (1 - np.abs(bright - bright[i]))
    return np.round(score, 9)


def autofill(known: DataFrame, size: int = 20) -> DataFrame:
    """From each cluster's first track on, the best mix next, up to a set's size."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        bpm, rms, bright, keys = rows.bpm.to_numpy(), rows.rms_energy.to_numpy(), rows.brightness.to_numpy(), rows.camelot_key.tolist()
        path, left = [0], list(range(1, len(rows)))
        while left and len(path) < size:
            scores = mix_scores(bpm, keys, rms, bright, path[-1])[left]
            path.append(left.pop(int(np.argmax(scores))))
        return pd.DataFrame({"cluster_id": rows.cluster_id.iloc[0], "pos": rows.pos.to_numpy()[path], "seq": np.arange(1, len(path) + 1, dtype=np.int32)})

    good = known.where("bpm > 0").select("cluster_id", "pos", "bpm", "camelot_key", "rms_energy", "brightness")
    return good.groupBy("cluster_id").applyInPandas(work, ORDER)


def fill(rows: DataFrame, limit_sec: float, order: str = "distance") -> DataFrame:
    """First pass of the duration build: tracks in order; those that would go over the limit are left out.

    A fold over each cluster's array of tracks, on the JVM.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("pos").alias("pos"), F.coalesce("duration", F.lit(0.0)).alias("d"))))
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<bigint>").alias("taken"))
    fits = lambda s, x: (x["d"] > 0) & (s["total"] + x["d"] <= limit_sec)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["total"] + x["d"]).alias("total"), F.concat(s["taken"], F.array(x["pos"])).alias("taken"))).otherwise(s)
    folded = rows.groupBy("cluster_id").agg(F.aggregate(items, start, step).alias("s"))
    return folded.select("cluster_id", F.posexplode("s.taken").alias("seq", "pos")).withColumn("seq", F.col("seq") + 1)


#: Left-over tracks that are offered at once in the second pass of a duration build.
OFFERED = 4096


def duration_build(rows: DataFrame, distances: DataFrame, target_min: float, tolerance: float = 0.1) -> DataFrame:
    """Both passes: what is left of the first is offered to clusters by distance, in the order of positions.

    rows: cluster_id, pos, duration, distance; distances: pos, cluster_id, distance
    (all equal where the two spaces differ in length). A track goes to the
    nearest cluster that has room for it, and room only shrinks: a track that
    fits nowhere now fits nowhere later. So the second pass is rounds. All tasks
    look for tracks that some cluster has room for, past those offered before;
    the first ``OFFERED`` of them, with the clusters that they fit, are placed
    one after the other, and the next round looks with the room that is left. A
    round's work is spread over all tracks; what meets is a number for each
    cluster and one block of tracks.
    """
    limit = target_min * 60 * (1 + tolerance)
    first = fill(rows, limit).persist()
    left = rows.join(first.select("pos"), "pos", "left_anti").where("duration > 0").select("pos", "duration")
    used = rows.join(first.select("pos"), "pos").groupBy("cluster_id").agg(F.sum("duration").alias("used"))
    offers = left.join(distances, "pos").groupBy("pos", "duration").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.round("distance", 9).alias("d"), "cluster_id"))), lambda x: x["cluster_id"]).alias("clusters")).persist()
    clusters = rows.select("cluster_id").distinct().join(used, "cluster_id", "left").select("cluster_id", F.coalesce("used", F.lit(0.0)).alias("used"))
    total = {r.cluster_id: r.used for r in clusters.collect()}
    placed, last = [], None
    while total:
        names = sorted(total)
        room = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(float(total[c])) for c in names]))
        fits = F.filter("clusters", lambda c: F.element_at(F.col("room"), c) + F.col("duration") <= limit)
        rest = offers if last is None else offers.where(F.col("pos") > last)
        some = rest.where(F.col("duration") + min(total.values()) <= limit).withColumn("room", room).select("pos", "duration", fits.alias("fits")).where("size(fits) > 0")
        block = some.orderBy("pos").limit(OFFERED).collect()
        for r in block:
            home = next((c for c in r.fits if total[c] + r.duration <= limit), None)
            if home is not None:
                total[home] += r.duration
                placed.append((home, r.pos))
        if len(block) < OFFERED:
            break
        last = block[-1].pos
    offers.unpersist()
    second = rows.sparkSession.createDataFrame(placed, "cluster_id string, pos long")
    return first.select("cluster_id", "pos", F.lit(1).alias("pass")).union(second.select("cluster_id", "pos", F.lit(2).alias("pass")))


def shuffled(n: int, seed: int) -> list[int]:
    """The seeded order of so many tracks."""
    places = list(range(n))
    random.Random(seed).shuffle(places)
    return places


def split(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Clusters over a size in parts of it, tracks dealt by the seeded shuffle of their number.

    A permutation depends on the number of tracks only; the sizes that occur are few.
    """
    ranked = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list("pos")).alias("all")).withColumn("n", F.size("all"))
    sizes = [r.n for r in ranked.select("n").distinct().collect() if r.n > size]
    if sizes:
        table = rows.sparkSession.createDataFrame([(n, shuffled(n, seed)) for n in sizes], "n int, places array<int>")
        ranked = ranked.join(F.broadcast(table), "n", "left")
    else:
        ranked = ranked.withColumn("places", F.lit(None).cast("array<int>"))
    dealt = F.when(F.col("places").isNull(), F.col("all")).otherwise(F.transform("places", lambda k: F.get(F.col("all"), k)))
    out = ranked.select("cluster_id", "n", F.posexplode(dealt).alias("k", "pos"))
    part = F.when(F.col("n") > size, F.concat("cluster_id", F.lit("_"), F.floor(F.col("k") / size).cast("string"))).otherwise(F.col("cluster_id"))
    return out.select(part.alias("cluster_id"), "pos", (F.when(F.col("n") > size, F.col("k") % size).otherwise(F.col("k")) + 1).cast("int").alias("seq"))
