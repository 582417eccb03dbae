"""Filters, lookups and neighbours of tracks, for any library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import exprs as X

#: Ranges of vocal presence; what is between the two is neither.
VOCAL = {"Instrumental": (0.0, 0.3), "Vocal": (0.6, 1.0)}


def vocal(kind: str) -> Column:
    """Whether a track is Instrumental or Vocal; Any lets all pass."""
    if kind == "Any":
        return F.lit(True)
    if kind not in VOCAL:
        raise ValueError(f"unknown kind {kind!r}; there are Any, {', '.join(VOCAL)}")
    return F.col("vocal_presence").between(*VOCAL[kind])


def search(tracks: DataFrame, text: str) -> DataFrame:
    """Tracks whose shown title, artist or whole tempo holds the text, in any case; an empty text finds all."""
    if not text:
        return tracks
    part = F.lit(text.lower())
    return tracks.where(F.contains(F.lower(X.display_title()), part) | F.contains(F.lower("artist"), part) | F.contains(F.col("bpm").cast("bigint").cast("string"), part))


def library(tracks: DataFrame, tags: DataFrame | None = None, *, text: str = "", suffix: str | None = None, tag: str = "") -> DataFrame:
    """Tracks of a kind of file, with a text in title or artist and a text in one of their tags; what is not asked for lets all pass.

    tags: pos, tag.
    """
    if suffix is not None:
        tracks = tracks.where(X.suffix("path") == suffix.lower())
    if text:
        part = F.lit(text.lower())
        tracks = tracks.where(F.contains(F.lower(X.display_title()), part) | F.contains(F.lower(F.coalesce("artist", F.lit(""))), part))
    if tag:
        if tags is None:
            raise ValueError("a tag is asked for, but there are no tags")
        tracks = tracks.join(tags.where(F.contains(F.lower("tag"), F.lit(tag.lower()))), "pos", "left_semi")
    return tracks


def block_of(energy: Column, blocks: list[tuple[str, float, float]]) -> Column:
    """The first of the blocks (name, least, most) whose range holds the energy; null if none does."""
    return F.coalesce(*[F.when(energy.between(lo, hi), name) for name, lo, hi in blocks], F.lit(None).cast("string"))


def resolve_genre(tracks: DataFrame, overrides: DataFrame, root: str, inferred: Column | None = None) -> DataFrame:
    """``resolved``: the override by path, by path under the root, by file name; else a known genre tag; else what is inferred; else unknown.

    overrides: name, genre, each name once.
    """
    root = root.rstrip("/") + "/"
    below = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path"))
    found = []
    for k, key in enumerate((F.col("path"), below, F.element_at(F.split("path", "/"), -1))):
        side = overrides.select(F.col("name").alias(f"_name{k}"), F.col("genre").alias(f"_genre{k}"))
        tracks = tracks.join(side, key == F.col(f"_name{k}"), "left").drop(f"_name{k}")
        found.append(f"_genre{k}")
    tag = F.lower(F.trim("genre"))
    known = F.when(tag.isin(*X.KNOWN_GENRES), tag)
    return tracks.withColumn("resolved", F.coalesce(*found, known, *([inferred] if inferred is not None else []), F.lit("unknown"))).drop(*found)


def genre_vote(tracks: DataFrame) -> DataFrame:
    """(cluster_id, genre, n): the genre that most of a cluster's tracks have, of equals the first by name; tracks without one don't vote."""
    votes = tracks.where("genre IS NOT NULL").groupBy("cluster_id", F.lower(F.trim("genre")).alias("genre")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "genre")
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def chapter_summary(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Per cluster: tracks, length in seconds and as text, and the range of energy, from 0 to 1 where none is known."""
    out = tracks.join(features, "pos", "left").groupBy("cluster_id").agg(
        F.count("*").alias("track_count"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("total_duration"), F.coalesce(F.min("rms_energy"), F.lit(0.0)).alias("energy_min"), F.coalesce(F.max("rms_energy"), F.lit(1.0)).alias("energy_max")
    )
    s = F.col("total_duration").cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    long = F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s % 3600 / 60)), two(s % 60))
    return out.withColumn("duration_str", F.when(s >= 3600, long).otherwise(X.minutes_seconds(F.col("total_duration"))))


def transitions(known: DataFrame, order: str = "pos") -> DataFrame:
    """(cluster_id, pos, score, color): mix score with the next track of the cluster; gray without one or without a tempo."""
    row = F.struct("bpm", "camelot_key", "rms_energy", "brightness")
    rows = known.select("cluster_id", "pos", row.alias("x"), F.lead(row).over(Window.partitionBy("cluster_id").orderBy(order)).alias("y"))
    score = F.when(F.col("x.bpm").isNotNull() & F.col("y.bpm").isNotNull(), F.round(X.compatibility("x", "y"), 9))
    return rows.select("cluster_id", "pos", score.alias("score")).withColumn("color", X.transition_color(F.col("score")))


def key_dots(known: DataFrame, order: str = "pos") -> DataFrame:
    """(cluster_id, pos, dot): how each track's key goes with that of the one before."""
    before = F.lag("camelot_key").over(Window.partitionBy("cluster_id").orderBy(order))
    return known.withColumn("before", before).select("cluster_id", "pos", X.key_dot("before", "camelot_key").alias("dot"))


def split_sizes(tracks: DataFrame, tracks_at_most: int = 25, minutes_at_most: float = 25) -> DataFrame:
    """(cluster_id, n, dur, split_size): the part size of clusters over so many tracks or minutes; null for the others."""
    limit = minutes_at_most * 60
    per = tracks.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("dur"))
    over = (F.col("n") > tracks_at_most) | (F.col("dur") > limit)
    fits = F.when(F.col("dur") > 0, F.greatest(F.lit(1), (limit / (F.col("dur") / F.col("n"))).cast("int"))).otherwise(tracks_at_most)
    return per.withColumn("split_size", F.when(over, fits))
