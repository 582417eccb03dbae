"""The best next tracks of every track, by cells of tempo, energy and brightness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import exprs as X

#: What a unit of each measure takes off the score, and what keys that don't fit take.
LOSS = {"bpm": 0.3 / 20, "rms_energy": 0.25, "brightness": 0.15}
KEY_LOSS = 0.3

#: Sides of cells, as a loss: from the widest, which stays below what a key takes, each half the one before.
SIDES = [0.25 / (1 << k) for k in range(17)]

#: Places that a cell of the first round may hold, where the narrowest is not over it anyway.
CROWD = 16

#: Far more than distances lose by rounding.
SLACK = 1e-8

#: Places without enough neighbours that are sent to all tasks, at most.
SENT = 1 << 16


def _partners() -> list[list[int]]:
    """For each key, numbered 2 x number + letter from 0, those that fit it."""
    fits = lambda a, b: abs(a // 2 - b // 2) in ((0, 1, 11) if a % 2 == b % 2 else (0, 3, 9))
    return [[b for b in range(24) if fits(a, b)] for a in range(24)]


def _cells(of: str, side: float) -> list[Column]:
    return [F.floor(F.col(f"{of}.{c}") * loss / side).alias(f"cell_{c}") for c, loss in LOSS.items()]


def _best(pairs: DataFrame, n: int) -> DataFrame:
    """(x, other, score): the n best of each place asked for."""
    order = Window.partitionBy("x").orderBy(F.desc("score"), "other")
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def _search(asked: DataFrame, pool: DataFrame, n: int, key: float) -> tuple[list[DataFrame], DataFrame]:
    """What rounds of wider and wider cells settle, and the places that none of them did.

    asked: x, groups; pool: y, at, group. In a round a place meets the cells
    next to its own. All within one side are there, so n of them are the best.
    """
    crowds = pool.select("group", F.posexplode(F.array(*[F.struct(*_cells("y", s)) for s in SIDES])).alias("k", "cell"))
    fullest = {r.k: r.n for r in crowds.groupBy("k", "group", "cell").count().groupBy("k").agg(F.max("count").alias("n")).collect()}
    start = next((k for k in range(len(SIDES)) if fullest.get(k, 0) <= CROWD), len(SIDES) - 1)
    around = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    done = []
    for side in reversed(SIDES[: start + 1]):
        looks = asked.select("x", F.explode("groups").alias("group"), *_cells("x", side))
        for c in LOSS:
            looks = looks.withColumn("step", F.explode(around)).withColumn(f"cell_{c}", F.col(f"cell_{c}") + F.col("step")).drop("step")
        near = looks.join(pool.select("group", "y", "at", *_cells("y", side)), ["group", *(f"cell_{c}" for c in LOSS)])
        score = F.round(X.mix_score("x", "y", F.lit(key)), 9)
        pairs = near.withColumn("score", score).where(F.col("score") > 1 - KEY_LOSS * (1 - key) - side + SLACK)
        best = _best(pairs.select("x", "score", F.explode("at").alias("other")), n)
        found = best.groupBy("x").agg(F.collect_list(F.struct((-F.col("score")).alias("loss"), "other")).alias("best")).where(F.size("best") >= n).persist()
        done.append(found)
        asked = asked.join(found.select("x"), "x", "left_anti").persist()
        if asked.isEmpty():
            break
    return done, asked


def next_tracks(tracks: DataFrame, top: int = 5) -> DataFrame:
    """(pos, other, score, rank): the best next tracks of each of ``tracks``, by mix score, ties by position.

    Tracks alike in all that the score sees are one place, of which the first
    ``top + 1`` can be anybody's best; so copies cost nothing. Places with a key
    look among those that fit, whatever doesn't fit being further than the
    widest cell; places without one look among all. What no round settles has
    few others within the widest cell, so there are only so many of these as
    cells in the ranges of tempo and energy; they are compared with every place.
    Tracks without tempo, energy or brightness take no part; fewer than ``top``
    others give fewer rows.
    """
    n = top + 1
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in LOSS])
    place = F.struct(*[F.col(c).cast("double").alias(c) for c in LOSS], F.coalesce("camelot_key", F.lit("")).alias("camelot_key"))
    tracks = tracks.where(known).select("pos", place.alias("x"))
    first = tracks.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("pos"))).where(F.col("r") <= n)
    number = (X.key_number("x.camelot_key") - 1) * 2 + (X.key_letter("x.camelot_key") == "B").cast("int")
    places = first.groupBy("x").agg(F.array_sort(F.collect_list("pos")).alias("at")).withColumn("key", F.when(number.between(0, 23), number)).persist()

    pool = places.select(F.col("x").alias("y"), "at", F.col("key").alias("group"))
    partners = F.array(*[F.array(*map(F.lit, p)) for p in _partners()])
    keyed, rest = _search(places.where("key IS NOT NULL").select("x", F.get(partners, F.col("key")).alias("groups")), pool.where("group IS NOT NULL"), n, 1.0)
    loose, bare = _search(places.where("key IS NULL").select("x", F.array(F.lit(0)).alias("groups")), pool.withColumn("group", F.lit(0)), n, 0.0)
    rest = rest.select("x").union(bare.select("x"))
    few = rest.count()
    rest = F.broadcast(rest) if few <= SENT else rest
    pairs = pool.join(rest).select("x", F.round(X.compatibility("x", "y"), 9).alias("score"), F.explode("at").alias("other"))
    wide = _best(pairs, n).groupBy("x").agg(F.collect_list(F.struct((-F.col("score")).alias("loss"), "other")).alias("best"))
    found = reduce(DataFrame.unionByName, [*keyed, *loose, wide] if few else [*keyed, *loose])

    others = F.slice(F.filter(F.array_sort("best"), lambda b: b["other"] != F.col("pos")), 1, top)
    out = tracks.join(found, "x").select("pos", F.posexplode(others).alias("r", "b"))
    return out.select("pos", F.col("b.other").alias("other"), (-F.col("b.loss")).alias("score"), (F.col("r") + 1).cast("int").alias("rank"))
