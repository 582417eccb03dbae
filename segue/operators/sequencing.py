"""Orders of tracks inside their clusters, as windows with the position last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import exprs as X

#: The order of the five phases.
PHASES = ("flowing", "staccato", "chaos", "lyrical", "stillness")

#: Fixed: the strategies that ``sequence`` knows.
STRATEGIES = ("ramp", "build", "descent", "bpm_asc", "bpm_desc", "intro_asc", "intro_desc", "fixed", "alternating")


def ordered(rows: DataFrame, *keys: Column, cluster: str = "cluster_id") -> DataFrame:
    """``seq`` from 1 in each cluster; ties keep the order of positions."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(cluster).orderBy(*keys, "pos")))


def sequence(known: DataFrame, strategy: str) -> DataFrame:
    """The cluster's tracks in the order of a strategy; ``fixed`` keeps positions, an unknown one is an error."""
    bpm = F.coalesce("bpm", F.lit(0.0))
    keys = {
        "ramp": [F.col("rms_energy").asc()], "build": [F.col("energy_gradient").desc()], "descent": [F.col("rms_energy").desc()],
        "bpm_asc": [bpm.asc()], "bpm_desc": [bpm.desc()], "intro_asc": [F.col("intro_length_secs").asc()], "intro_desc": [F.col("intro_length_secs").desc()],
        "fixed": [],
    }
    if strategy == "alternating":
        return alternating(known)
    if strategy not in keys:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return ordered(known, *keys[strategy])


def alternating(known: DataFrame) -> DataFrame:
    """High and low energy in turn: the high half from its top, the low half from its bottom."""
    order = Window.partitionBy("cluster_id").orderBy("rms_energy", "pos")
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    half = F.floor(F.col("n") / 2)
    rows = known.withColumn("i", F.row_number().over(order) - 1).withColumn("n", n)
    # of an odd number the high half has one more, and it ends the order
    place = F.when(F.col("i") >= half, 2 * (F.col("n") - 1 - F.col("i"))).otherwise(2 * F.col("i") + 1)
    return rows.withColumn("seq", (place + 1).cast("int")).drop("i", "n")


def anchored(known: DataFrame, openers: DataFrame, closers: DataFrame) -> DataFrame:
    """First the opener, last the closer, the rest by hardness; clusters of up to two tracks stay."""
    rows = known.join(openers.select("cluster_id", F.col("pos").alias("opener")), "cluster_id", "left").join(closers.select("cluster_id", F.col("pos").alias("closer")), "cluster_id", "left")
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    slot = F.when(F.col("pos") == F.col("opener"), 0).when(F.col("pos") == F.col("closer"), 2).otherwise(1)
    hard = F.coalesce(X.hardness(), F.lit(0.5))
    return ordered(rows.withColumn("n", n), F.when(F.col("n") > 2, slot).otherwise(0), F.when(F.col("n") > 2, hard).otherwise(0.0)).drop("n", "opener", "closer")


def ranked(tracks: DataFrame, features: DataFrame, opener: bool, top: int = 5) -> DataFrame:
    """(cluster_id, rank, pos, score, reason): the best openers or closers of each cluster."""
    rows = tracks.join(features.withColumn("has", F.lit(True)), "pos", "left")
    d = F.coalesce("duration", F.lit(0.0))
    score, reason = (X.opener_score(d), X.opener_reason(d)) if opener else (X.closer_score(d), X.closer_reason(d))
    alone = F.count("*").over(Window.partitionBy("cluster_id")) == 1
    rows = rows.withColumn("alone", alone).withColumn("score", F.when(F.col("alone"), 1.0).when(F.col("has").isNull(), -1.0).otherwise(score))
    rows = rows.withColumn("reason", F.when(F.col("alone"), "only track in cluster").when(F.col("has").isNull(), "missing intensity data").otherwise(reason))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster_id", "rank", "pos", "score", "reason")


def offsets(rows: DataFrame) -> DataFrame:
    """Start of each track: the durations of those before it."""
    before = Window.partitionBy("cluster_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.coalesce("duration", F.lit(0.0))).over(before), F.lit(0.0)))


def five_rhythms(known: DataFrame) -> DataFrame:
    phase = X.five_rhythms(F.col("bpm"), F.col("rms_energy"))
    rank = X.lookup(F.col("phase"), {p: k for k, p in enumerate(PHASES)})
    return ordered(known.withColumn("phase", phase), rank, F.col("rms_energy"))


def fresh(known: DataFrame, history: DataFrame, as_of: Column, least: float = 0.1) -> DataFrame:
    """By freshness times energy, the greatest first; tracks that are less fresh than ``least`` go.

    history: pos, times_used, last_used; tracks without a row were never played.
    """
    rows = known.join(history, "pos", "left").withColumn("freshness", X.freshness("times_used", "last_used", as_of)).where(F.col("freshness") >= least)
    return ordered(rows, F.round(F.col("freshness") * F.col("rms_energy"), 9).desc())


def require(tracks: DataFrame, features: DataFrame, key: str = "pos") -> DataFrame:
    """The tracks, if all of them have features; else an error that names one that hasn't."""
    missing = tracks.join(features.select(key), key, "left_anti").select(key).first()
    if missing is not None:
        raise ValueError(f"missing features for track {missing[0]}")
    return tracks


def move(order: DataFrame, cluster: str, source: int, target: int) -> DataFrame:
    """A playlist's order after its track at ``source`` was moved to ``target``; the others close up."""
    seq = F.col("seq")
    low, high, step = (source, target, -1) if source < target else (target, source, 1)
    shifted = F.when(seq == source, F.lit(target)).when(seq.between(low, high), seq + step).otherwise(seq)
    return order.withColumn("seq", F.when(F.col("cluster_id") == cluster, shifted).otherwise(seq).cast("int"))


def remove(order: DataFrame, cluster: str, pos: int) -> DataFrame:
    """A playlist's order without a track; those behind it close up."""
    gone = (F.col("cluster_id") == cluster) & (F.col("pos") == pos)
    return order.where(~gone).withColumn("seq", F.row_number().over(Window.partitionBy("cluster_id").orderBy("seq")))


def append(order: DataFrame, cluster: str, tracks: DataFrame) -> DataFrame:
    """A playlist's order with some tracks (pos) at its end, by position; those it has stay where they are."""
    new = tracks.select("pos").distinct().join(order.where(F.col("cluster_id") == cluster).select("pos"), "pos", "left_anti")
    last = order.where(F.col("cluster_id") == cluster).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    rank = F.row_number().over(Window.orderBy("pos"))
    return order.unionByName(new.crossJoin(F.broadcast(last)).select(F.lit(cluster).alias("cluster_id"), "pos", (F.col("last") + rank).cast("int").alias("seq")))


#: A library's and a playlist's columns that can be sorted by, and what stands for a missing cell.
SORTS = {"title": "", "artist": "", "genre": "", "mood": "", "path": "", "bpm": 0.0, "duration": 0.0, "rms_energy": 0.0, "year": 0}


#: Positions in a range of rows without a cell.
PART = 1 << 16


def sort_by(rows: DataFrame, column: str, descending: bool = False, within: str | None = None) -> DataFrame:
    """``seq`` by a column, texts in any case; ties keep positions. With ``within``, in each of its values.

    Without it the order is global: only counts of ranges of cells (texts by
    their first letters, numbers by whole ones, missing cells by position) are
    summed over all, and places inside a range are counted in it.
    """
    if column not in SORTS:
        raise ValueError(f"can't sort by {column!r}; there are {', '.join(SORTS)}")
    text = SORTS[column] == ""
    cell = F.coalesce(column, F.lit(SORTS[column]))
    cell = F.lower(cell) if text else cell
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if within is not None:
        return ordered(rows, cell.desc() if descending else cell.asc(), cluster=within)
    bare = cell == F.lit(SORTS[column])
    spot = {"sort_cell": cell, "sort_head": F.substring(cell, 1, 3) if text else F.floor(cell), "sort_bare": bare, "sort_part": F.when(bare, F.floor(F.col("pos") / PART)).otherwise(0)}
    keyed = rows.withColumns(spot)
    part = ["sort_head", "sort_bare", "sort_part"]
    before = Window.orderBy(way("sort_head"), F.col("sort_bare").asc() if descending else F.col("sort_bare").desc(), "sort_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keyed.groupBy(*part).agg(F.count("*").alias("n")).select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sort_ahead"))
    keyed = keyed.withColumn("sort_rank", F.row_number().over(Window.partitionBy(*part).orderBy(way("sort_cell"), "pos"))).join(ahead, part)
    return keyed.withColumn("seq", F.col("sort_ahead") + F.col("sort_rank")).drop(*spot, "sort_ahead", "sort_rank")
