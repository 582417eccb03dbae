"""Filters and lookups at their edges."""

import pytest
from pyspark.sql import functions as F

from segue.operators import selecting as C

TRACKS = "pos long, path string, title string, artist string, bpm double, duration double, genre string, cluster_id string"


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame(
        [
            (1, "/music/a/One.FLAC", "One", "Ann", 128.0, 100.0, " House ", "x"),
            (2, "/music/b/two.mp3", None, None, None, None, None, "x"),
            (3, "/other/three.mp3", "Three", "Bob", 90.5, 4000.0, "Polka", "y"),
        ],
        TRACKS,
    )


def found(rows):
    return sorted(r.pos for r in rows.collect())


def test_search_and_library(spark, tracks):
    assert found(C.search(tracks, "")) == [1, 2, 3]
    assert found(C.search(tracks, "ANN")) == [1]
    assert found(C.search(tracks, "90")) == [3]
    assert found(C.library(tracks)) == [1, 2, 3]
    assert found(C.library(tracks, suffix=".FLAC")) == [1]
    tags = spark.createDataFrame([(3, "Warm"), (3, "warm-up"), (2, None)], "pos long, tag string")
    assert found(C.library(tracks, tags, tag="WARM")) == [3]
    with pytest.raises(ValueError, match="no tags"):
        C.library(tracks, tag="warm")


def test_vocal(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 0.45), (4, 0.6), (5, None)], "pos long, vocal_presence double")
    assert [found(rows.where(C.vocal(k))) for k in ("Any", "Instrumental", "Vocal")] == [[1, 2, 3, 4, 5], [1, 2], [4]]
    with pytest.raises(ValueError, match="unknown kind"):
        C.vocal("Choir")


def test_genres(spark, tracks):
    overrides = spark.createDataFrame([("b/two.mp3", "dnb"), ("three.mp3", "techno")], "name string, genre string")
    got = {r.pos: r.resolved for r in C.resolve_genre(tracks, overrides, "/music/").collect()}
    assert got == {1: "house", 2: "dnb", 3: "techno"}
    none = overrides.where(F.lit(False))
    assert {r.pos: r.resolved for r in C.resolve_genre(tracks, none, "/music").collect()} == {1: "house", 2: "unknown", 3: "unknown"}
    assert {(r.cluster_id, r.genre, r.n) for r in C.genre_vote(tracks).collect()} == {("x", "house", 1), ("y", "polka", 1)}


def test_blocks_and_parts(spark, tracks):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, None)], "pos long, rms_energy double")
    block = C.block_of(F.col("rms_energy"), [("low", 0.0, 0.35), ("mid", 0.3, 0.7)])
    assert [r.b for r in rows.orderBy("pos").select(block.alias("b")).collect()] == ["low", None, None]
    assert {r.cluster_id: r.split_size for r in C.split_sizes(tracks).collect()} == {"x": None, "y": 1}
    lengthless = tracks.withColumn("duration", F.lit(None).cast("double"))
    assert {r.split_size for r in C.split_sizes(lengthless, tracks_at_most=1).collect()} == {1, None}
    assert {r.cluster_id: r.duration_str for r in C.chapter_summary(tracks, rows).collect()} == {"x": "1:40", "y": "1:06:40"}
