"""Readers: audio folders, tag maps, Rekordbox collections, crate databases, JSON stores."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions import exprs as X

TRACK_XML = (
    "struct<_TrackID:string,_Name:string,_Artist:string,_Location:string,_AverageBpm:string,_Tonality:string,_TotalTime:string,"
    "POSITION_MARK:array<struct<_Name:string,_Start:string,_Num:string,_Type:string>>>"
)


def scan(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, length) of the audio files below some folders, by suffix in any case.

    Only names and lengths are read; a folder that is given twice counts twice.
    """
    found = None
    for folder in folders:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
        found = one if found is None else found.unionAll(one)
    return found.where(X.suffix("path").isin(*X.AUDIO_EXTENSIONS))


def location(url: Column) -> Column:
    """A path without its file prefix; null where there is none."""
    return F.nullif(F.regexp_replace(url, "^file://(localhost)?", ""), F.lit(""))


def position_marks(marks: Column) -> Column:
    """Cue points by position; marks without a readable start go."""
    num = lambda m: m["_Num"].try_cast("int")
    kind = lambda m: F.when(num(m).between(0, 7), "hot_cue").when(num(m) == 8, "memory_cue").otherwise("unknown")
    read = F.transform(F.coalesce(marks, F.array().cast("array<struct<_Name:string,_Start:string,_Num:string,_Type:string>>")),
        lambda m: F.struct(m["_Start"].try_cast("double").alias("position_ms"), F.coalesce(m["_Name"], F.lit("")).alias("name"), kind(m).alias("type")))
    return F.array_sort(F.filter(read, lambda m: m["position_ms"].isNotNull()))


def collection(tracks: DataFrame) -> DataFrame:
    """Imported tracks from parsed TRACK rows; playlist references have no location and go."""
    out = tracks.select(
        location(F.col("_Location")).alias("location"), F.col("_AverageBpm").try_cast("double").alias("bpm"),
        X.camelot(F.coalesce("_Tonality", F.lit(""))).alias("key"), position_marks(F.col("POSITION_MARK")).alias("cue_points"),
    )
    return out.where("location IS NOT NULL")


def rekordbox(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a Rekordbox XML export."""
    fields = "_TrackID string, _Name string, _Artist string, _Location string, _AverageBpm string, _Tonality string, _TotalTime string, POSITION_MARK array<struct<_Name:string,_Start:string,_Num:string,_Type:string>>"
    return collection(spark.read.format("xml").option("rowTag", "TRACK").schema(fields).load(path))


def json_store(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(path, value) of a JSON object with one entry per path; a corrupt file has none."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string,{value}>")
    return text.select(F.explode(entries).alias("path", "entry")).select("path", "entry")


def crate_library(library: DataFrame, locations: DataFrame) -> DataFrame:
    """Library rows with their file's location, deleted ones left out."""
    rows = library.where("mixxx_deleted = 0").withColumnRenamed("location", "location_id")
    places = locations.select(F.col("id").alias("location_id"), F.col("location").alias("path"))
    return rows.join(places, "location_id")


def enrich(tracks: DataFrame, library: DataFrame, locations: DataFrame, cues: DataFrame) -> DataFrame:
    """Tracks with rating, play count, last play and cues from a crate database.

    A track without a match keeps what it has, and one without cues keeps its cues.
    """
    places = locations.where("fs_deleted = 0").select(F.col("id").alias("location_id"), F.col("location").alias("path"))
    rows = library.select(F.col("id").alias("track_id"), F.col("location").alias("location_id"), "rating", F.col("timesplayed").alias("play_count"), F.col("last_played_at").alias("last_played"), F.coalesce(F.nullif(F.col("samplerate"), F.lit(0)), F.lit(44100)).alias("rate")).join(places, "location_id")
    points = cues.join(rows.select("track_id", "rate"), "track_id").groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct((F.col("position") / F.col("rate")).alias("position"), F.coalesce("label", F.lit("")).alias("label"), F.when(F.col("type") == 1, F.col("hotcue")).alias("hotcue")))).alias("cues")
    )
    return tracks.join(rows.join(points, "track_id", "left").drop("location_id", "rate"), "path", "left")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by order: what an upsert log amounts to."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in columns])


def missing_from(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The rows that a cache hasn't."""
    return rows.join(cache.select(key), key, "left_anti")


def footer(files: DataFrame) -> DataFrame:
    """How many files, and their bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def replace_crate(crate_tracks: DataFrame, crate_id: int, locations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Crate rows after a crate was written anew from wanted (location); unknown locations are left out."""
    ours = wanted.join(locations, "location").select(F.lit(crate_id).cast("long").alias("crate_id"), F.col("id").alias("track_id")).distinct()
    return crate_tracks.where(F.col("crate_id") != crate_id).unionByName(ours)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with new ones in place of those of the same key."""
    return missing_from(old, new, key).unionByName(new)


def save_json(rows: DataFrame, path: str, key: str = "path", entry: str = "entry") -> int:
    """Writes a JSON object with one entry per key to a local file, by key, and tells how many; what ``json_store`` reads.

    Entries that are empty arrays or null are left out. The file takes the old
    one's place when it is whole. Rows come to the driver a partition at a time.
    """
    cell = F.to_json(F.struct(F.col(entry).alias("e")))
    lines = rows.where(F.col(entry).isNotNull()).orderBy(key).select(F.to_json(F.struct(F.col(key).alias("k"))).alias("k"), cell.alias("e"))
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(f"{path}.new", "w", encoding="utf-8") as out:
        out.write("{")
        for r in lines.toLocalIterator():
            value = json.loads(r.e)["e"]
            if value != []:
                out.write(f"{',' if n else ''}\n  {json.dumps(json.loads(r.k)['k'])}: {json.dumps(value, sort_keys=True)}")
                n += 1
        out.write("\n}\n" if n else "}\n")
    os.replace(f"{path}.new", path)
    return n
