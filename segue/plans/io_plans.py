"""Sources and sinks as queries."""

from __future__ import annotations

import io
import os
import sqlite3
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from segue.functions import exprs as X
from segue.operators import render as R
from segue.sources import library as L
from segue.sources import npy, sqlite_source
from segue.sources.fixtures import Views

from .base import Catalogue
from .scalar_plans import TITLE, cue_sql

CATALOGUE = Catalogue()
query = CATALOGUE.add

SEQ = "seqd AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS seq FROM tracks)"
ARTIST = "coalesce(nullif(artist, ''), 'Unknown')"
EXTINF = f"concat('#EXTINF:', CAST(CAST(coalesce(duration, 0) AS BIGINT) AS VARCHAR), ',', {ARTIST}, ' - ', {TITLE})"
SHORT = "regexp_replace(path, '^/music/', '')"


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _tracks(v: Views):
    return R.numbered(v.tracks)


@query("SELECT lower(regexp_extract(path, '\\.[^./]+$')) AS ext, count(*) AS n FROM tracks GROUP BY 1")
def scan_ext_histogram(v: Views):
    return v.tracks.groupBy(X.suffix("path").alias("ext")).agg(F.count("*").alias("n"))


@query("SELECT l.id, l.rating, l.timesplayed, l.bpm, t.location AS path FROM library l JOIN track_locations t ON l.location = t.id WHERE l.mixxx_deleted = 0")
def crate_read(v: Views):
    return L.crate_library(v.library, v.track_locations).select("id", "rating", "timesplayed", "bpm", "path")


_CUES = "SELECT c.track_id, c.position / coalesce(nullif(l.samplerate, 0), 44100) AS seconds, coalesce(c.label, '') AS label, CASE WHEN c.type = 1 THEN c.hotcue END AS hotcue FROM cues c JOIN library l ON l.id = c.track_id"


@query(f"""WITH points AS ({_CUES}), per AS (SELECT track_id, count(*) AS n_cues, round(min(seconds), 6) AS first_cue, count(hotcue) AS n_hot FROM points GROUP BY track_id)
SELECT t.path, l.rating, l.timesplayed AS play_count, coalesce(n_cues, 0) AS n_cues, first_cue, coalesce(n_hot, 0) AS n_hot FROM (SELECT concat('/music/o', CAST(o_orderkey AS VARCHAR)) AS path FROM orders) t
LEFT JOIN (SELECT l.*, t.location AS path FROM library l JOIN track_locations t ON l.location = t.id WHERE t.fs_deleted = 0) l ON l.path = t.path LEFT JOIN per ON per.track_id = l.id""")
def crate_enrich_cues(v: Views):
    tracks = v.table("orders").select(F.concat(F.lit("/music/o"), F.col("o_orderkey").cast("string")).alias("path"))
    out = L.enrich(tracks, v.library, v.track_locations, v.cues)
    none = F.array().cast("array<struct<position:double,label:string,hotcue:int>>")
    cues = F.coalesce("cues", none)
    return out.select(
        "path", "rating", "play_count", F.size(cues).cast("long").alias("n_cues"), F.round(F.get(cues, F.lit(0))["position"], 6).alias("first_cue"), F.size(F.filter(cues, lambda c: c["hotcue"].isNotNull())).cast("long").alias("n_hot")
    )


@query("SELECT concat('Set ', CAST(o_custkey % 20 AS VARCHAR)) AS crate, count(*) AS n FROM orders o JOIN track_locations t ON t.id = o.o_orderkey GROUP BY 1")
def crate_sync_counts(v: Views):
    """Tracks that each crate takes: those whose location is known."""
    wanted = v.table("orders").select(F.concat(F.lit("Set "), (F.col("o_custkey") % 20).cast("string")).alias("crate"), F.concat(F.lit("/music/o"), F.col("o_orderkey").cast("string")).alias("location"))
    return wanted.join(v.track_locations, "location").groupBy("crate").agg(F.count("*").alias("n"))


@query("SELECT pos, k + 4 AS hotcue, concat('Cue ', CAST(k + 1 AS VARCHAR), ' Ms') AS label, CAST(trunc(ms / 1000.0::DOUBLE * 44100) AS BIGINT) AS position FROM (SELECT pos, k, CASE k WHEN 0 THEN intro_length_secs * 1000.5::DOUBLE ELSE rms_energy * 300000 END AS ms FROM features, (VALUES (0), (1)) v(k))")
def cue_positions_to_samples(v: Views):
    cues = F.create_map(F.lit("cue_1_ms"), F.col("intro_length_secs") * 1000.5, F.lit("cue_2_ms"), F.col("rms_energy") * 300000)
    rows = v.features.select("pos", F.posexplode(cues).alias("k", "name", "ms"))
    return rows.select("pos", (F.col("k") + 4).alias("hotcue"), X.title_case(F.replace("name", F.lit("_"), F.lit(" "))).alias("label"), (F.col("ms") / 1000.0 * 44100).cast("bigint").alias("position"))


@query(f"WITH {SEQ}, l AS (SELECT cluster_id, 0 AS seq, 0 AS k, '#EXTM3U' AS line FROM tracks GROUP BY cluster_id UNION ALL SELECT cluster_id, seq, 1, {EXTINF} FROM seqd UNION ALL SELECT cluster_id, seq, 2, {SHORT} FROM seqd) SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY seq, k) AS INT) AS line_no, line FROM l")
def m3u_lines(v: Views):
    return R.m3u(_tracks(v))


@query("SELECT cluster_id, concat('Playlist ', CAST(row_number() OVER (ORDER BY round(m, 9), cluster_id) AS VARCHAR), ' [', CAST(CAST(trunc(m) AS BIGINT) AS VARCHAR), '-', CAST(CAST(trunc(m + s) AS BIGINT) AS VARCHAR), 'bpm].m3u') AS file FROM (SELECT cluster_id, avg(bpm) AS m, stddev_pop(bpm) AS s FROM tracks GROUP BY cluster_id)")
def playlist_files(v: Views):
    per = v.tracks.groupBy("cluster_id").agg(F.avg("bpm").alias("m"), F.stddev_pop("bpm").alias("s"))
    number = F.row_number().over(Window.orderBy(F.round("m", 9), "cluster_id"))
    return per.select("cluster_id", R.file_name("Playlist", number, F.col("m"), F.col("s"), F.lit(None).cast("string"), ".m3u").alias("file"))


_CHAPTERS = "chapters AS (SELECT cluster_id, seq, concat('Part/', CAST(seq // 20 + 1 AS VARCHAR)) AS name FROM seqd WHERE (seq - 1) % 20 = 0)"


def _chapters(v: Views):
    rows = _tracks(v)
    return rows, rows.where((F.col("seq") - 1) % 20 == 0).select("cluster_id", "seq", F.concat(F.lit("Part/"), (F.floor(F.col("seq") / 20) + 1).cast("string")).alias("name"))


@query(f"WITH {SEQ}, {_CHAPTERS}, l AS (SELECT cluster_id, 0 AS seq, 0 AS k, '#EXTM3U' AS line FROM tracks GROUP BY cluster_id UNION ALL SELECT cluster_id, seq, 0, concat('# --- ', name, ' ---') FROM chapters UNION ALL SELECT cluster_id, seq, 1, {EXTINF} FROM seqd UNION ALL SELECT cluster_id, seq, 2, {SHORT} FROM seqd) SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY seq, k) AS INT) AS line_no, line FROM l")
def m3u_chapter_lines(v: Views):
    return R.m3u_chapters(*_chapters(v))


@query(f"""WITH {SEQ}, {_CHAPTERS}, m AS (SELECT *, concat(cluster_id, '/', lpad(CAST((seq - 1) // 20 + 1 AS VARCHAR), 2, '0'), '_Part_', CAST(((seq - 1) // 20 * 20 + 1) // 20 + 1 AS VARCHAR), '.m3u') AS file, concat('# Part/', CAST(((seq - 1) // 20 * 20 + 1) // 20 + 1 AS VARCHAR)) AS head FROM seqd),
l AS (SELECT file, 0 AS seq, 0 AS k, '#EXTM3U' AS line FROM m GROUP BY file UNION ALL SELECT file, 0, 1, any_value(head) FROM m GROUP BY file UNION ALL SELECT file, seq, 2, {EXTINF} FROM m UNION ALL SELECT file, seq, 3, {SHORT} FROM m) SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY seq, k) AS INT) AS line_no, line FROM l""")
def m3u_chapter_files(v: Views):
    return R.m3u_per_chapter(*_chapters(v))


_START = "coalesce(sum(coalesce(duration, 0)) OVER (PARTITION BY cluster_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_NO = "CASE WHEN seq < 10 THEN concat('0', CAST(seq AS VARCHAR)) ELSE CAST(seq AS VARCHAR) END"


@query(f"""WITH {SEQ}, o AS (SELECT *, {_START} AS start FROM seqd), l AS (SELECT cluster_id, 0 AS seq, 0 AS k, 'PERFORMER "Various Artists"' AS line FROM tracks GROUP BY cluster_id UNION ALL SELECT cluster_id, 0, 1, concat('TITLE "Cluster ', cluster_id, '"') FROM tracks GROUP BY cluster_id UNION ALL SELECT cluster_id, 0, 2, 'FILE "playlist.m3u" MP3' FROM tracks GROUP BY cluster_id
UNION ALL SELECT cluster_id, seq, 1, concat('  TRACK ', {_NO}, ' AUDIO') FROM o UNION ALL SELECT cluster_id, seq, 2, concat('    TITLE "', {TITLE}, '"') FROM o UNION ALL SELECT cluster_id, seq, 3, concat('    PERFORMER "', {ARTIST}, '"') FROM o UNION ALL SELECT cluster_id, seq, 4, concat('    REM BPM ', CAST(CAST(round_even(bpm, 0) AS BIGINT) AS VARCHAR)) FROM o WHERE bpm > 0 UNION ALL SELECT cluster_id, seq, 5, concat('    INDEX 01 ', {cue_sql('start')}) FROM o)
SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY seq, k) AS INT) AS line_no, line FROM l""")
def cue_sheet_lines(v: Views):
    return R.cue_sheet(_tracks(v))


_KIND = "CASE lower(regexp_extract(path, '\\.[^./]+$')) WHEN '.flac' THEN 'WAVE' WHEN '.wav' THEN 'WAVE' WHEN '.ogg' THEN 'OGG' ELSE 'MP3' END"
_WHO = "coalesce(nullif(artist, ''), 'Various Artists')"


@query(f"""WITH l AS (SELECT pos, 0 AS k, concat('PERFORMER "', {_WHO}, '"') AS line FROM tracks UNION ALL SELECT pos, 1, concat('TITLE "', {TITLE}, '"') FROM tracks UNION ALL SELECT pos, 2, concat('FILE "', regexp_replace(path, '^.*/', ''), '" ', {_KIND}) FROM tracks UNION ALL SELECT pos, 3, '  TRACK 01 AUDIO' FROM tracks UNION ALL SELECT pos, 4, concat('    TITLE "', {TITLE}, '"') FROM tracks
UNION ALL SELECT pos, 5, concat('    PERFORMER "', {_WHO}, '"') FROM tracks UNION ALL SELECT pos, 6, concat('    REM BPM ', CAST(CAST(round_even(bpm, 0) AS BIGINT) AS VARCHAR)) FROM tracks WHERE bpm > 0 UNION ALL SELECT pos, 7, '    INDEX 01 00:00:00' FROM tracks) SELECT pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY k) AS INT) AS line_no, line FROM l""")
def cue_track_lines(v: Views):
    return R.cue_per_track(v.tracks)


_FULL = "fullr AS (SELECT s.*, f.camelot_key, avg(bpm) OVER (PARTITION BY cluster_id) AS bpm_mean FROM seqd s LEFT JOIN features f USING (pos))"
_BPM = "printf('%.2f', coalesce(nullif(bpm, 0), bpm_mean))"


def _full(v: Views):
    rows = _tracks(v).join(v.features.select("pos", "camelot_key"), "pos", "left")
    rows = rows.withColumn("bpm_mean", F.avg("bpm").over(Window.partitionBy("cluster_id")))
    return rows, v.tracks.select("cluster_id", F.concat(F.lit("Playlist "), "cluster_id").alias("name")).distinct()


@query(f"""WITH {SEQ}, {_FULL}, l AS (
SELECT cluster_id, 0 AS part, 0 AS seq, k, x AS line FROM (SELECT DISTINCT cluster_id FROM tracks), (VALUES (0, '<DJ_PLAYLISTS Version="1.0.0">'), (1, '  <COLLECTION>')) h(k, x)
UNION ALL SELECT cluster_id, 1, seq, 0, concat('    <TRACK TrackID="', CAST(seq AS VARCHAR), '" Name="', {_esc(TITLE)}, '" Artist="', {_esc("coalesce(artist, '')")}, '" TotalTime="', CAST(CAST(coalesce(duration, 0) AS BIGINT) AS VARCHAR), '" AverageBpm="', {_BPM}, '" Tonality="', coalesce(camelot_key, ''), '" Location="', {_esc("concat('file://localhost', path)")}, '" />') FROM fullr
UNION ALL SELECT cluster_id, 2, 0, k, x FROM (SELECT DISTINCT cluster_id FROM tracks), (VALUES (0, '  </COLLECTION>'), (1, '  <PLAYLISTS>'), (2, '    <NODE Type="0" Name="ROOT">')) h(k, x)
UNION ALL SELECT DISTINCT cluster_id, 3, 0, 0, concat('      <NODE Type="1" Name="', {_esc("concat('Playlist ', cluster_id)")}, '">') FROM tracks
UNION ALL SELECT cluster_id, 4, seq, 0, concat('        <TRACK Key="', CAST(seq AS VARCHAR), '" />') FROM seqd
UNION ALL SELECT cluster_id, 5, 0, k, x FROM (SELECT DISTINCT cluster_id FROM tracks), (VALUES (0, '      </NODE>'), (1, '    </NODE>'), (2, '  </PLAYLISTS>'), (3, '</DJ_PLAYLISTS>')) h(k, x))
SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY part, seq, k) AS INT) AS line_no, line FROM l""")
def rekordbox_xml_lines(v: Views):
    return R.rekordbox_xml(*_full(v))


def _tag(name: str, c: str) -> str:
    return f"concat('      <{name}>', {_esc(c)}, '</{name}>')"


@query(f"""WITH {SEQ}, {_FULL}, n AS (SELECT cluster_id, CAST(count(*) AS VARCHAR) AS n FROM tracks GROUP BY cluster_id), l AS (
SELECT cluster_id, 0 AS part, 0 AS seq, 0 AS k, '<NML Version="19">' AS line FROM n UNION ALL SELECT cluster_id, 1, 0, 0, concat('  <COLLECTION ENTRIES="', n, '">') FROM n
UNION ALL SELECT cluster_id, 2, seq, 0, concat('    <ENTRY PRIMARYKEY="', {_esc('path')}, '">') FROM fullr UNION ALL SELECT cluster_id, 2, seq, 1, {_tag('TITLE', 'title')} FROM fullr WHERE title <> '' UNION ALL SELECT cluster_id, 2, seq, 2, {_tag('ARTIST', 'artist')} FROM fullr WHERE artist <> ''
UNION ALL SELECT cluster_id, 2, seq, 3, concat('      <LOCATION DIR="', {_esc("regexp_extract(path, '^(.*/)[^/]*$', 1)")}, '" FILE="', {_esc("regexp_replace(path, '^.*/', '')")}, '" VOLUME="" />') FROM fullr UNION ALL SELECT cluster_id, 2, seq, 4, concat('      <TEMPO BPM="', {_BPM}, '" />') FROM fullr
UNION ALL SELECT cluster_id, 2, seq, 5, {_tag('KEY', 'camelot_key')} FROM fullr WHERE camelot_key <> '' UNION ALL SELECT cluster_id, 2, seq, 6, concat('      <INFO PLAYTIME="', CAST(CAST(duration AS BIGINT) AS VARCHAR), '" />') FROM fullr WHERE duration > 0 UNION ALL SELECT cluster_id, 2, seq, 7, '    </ENTRY>' FROM fullr
UNION ALL SELECT cluster_id, 3, 0, k, x FROM n, (VALUES (0, '  </COLLECTION>'), (1, '  <PLAYLISTS>'), (2, '    <NODE TYPE="FOLDER" NAME="$ROOT">'), (3, '      <SUBNODES COUNT="1">')) h(k, x) UNION ALL SELECT cluster_id, 4, 0, 0, concat('        <NODE TYPE="PLAYLIST" NAME="', {_esc("concat('Playlist ', cluster_id)")}, '">') FROM n UNION ALL SELECT cluster_id, 4, 0, 1, concat('          <PLAYLIST ENTRIES="', n, '" TYPE="LIST">') FROM n
UNION ALL SELECT cluster_id, 5, seq, 0, '            <ENTRY>' FROM fullr UNION ALL SELECT cluster_id, 5, seq, 1, concat('              <PRIMARYKEY TYPE="TRACK" KEY="', {_esc('path')}, '" />') FROM fullr UNION ALL SELECT cluster_id, 5, seq, 2, '            </ENTRY>' FROM fullr
UNION ALL SELECT cluster_id, 6, 0, k, x FROM n, (VALUES (0, '          </PLAYLIST>'), (1, '        </NODE>'), (2, '      </SUBNODES>'), (3, '    </NODE>'), (4, '  </PLAYLISTS>'), (5, '</NML>')) h(k, x))
SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY part, seq, k) AS INT) AS line_no, line FROM l""")
def traktor_nml_lines(v: Views):
    return R.traktor_nml(*_full(v))


@query("""WITH raw AS (SELECT pos, CASE pos % 4 WHEN 0 THEN NULL ELSE path END AS location, CASE pos % 5 WHEN 0 THEN NULL ELSE TRY_CAST(concat(CAST(100 + pos % 60 AS VARCHAR), '.50') AS DOUBLE) END AS bpm, CASE pos % 3 WHEN 0 THEN '5A' WHEN 1 THEN '' ELSE '8B' END AS key FROM tracks)
SELECT location, bpm, key, CAST(CASE WHEN pos % 2 = 0 THEN 2 ELSE 0 END AS INT) AS n_cues, CASE WHEN pos % 2 = 0 THEN 10.5::DOUBLE END AS first_ms, CASE WHEN pos % 2 = 0 THEN 'memory_cue' END AS first_type FROM raw WHERE location IS NOT NULL""")
def xml_collection(v: Views):
    """A collection's TRACK elements, parsed and projected."""
    p, text = F.col("pos"), lambda c: c.cast("string")
    where = F.when(p % 4 == 0, "").otherwise(F.concat(F.lit(' Location="file://localhost'), "path", F.lit('"')))
    bpm = F.when(p % 5 == 0, "fast").otherwise(F.concat(text(100 + p % 60), F.lit(".50")))
    key = F.when(p % 3 == 0, "Cm").when(p % 3 == 1, "Bbx").otherwise("8b")
    marks = F.when(p % 2 == 0, '<POSITION_MARK Name="b" Start="99.25" Num="3"/><POSITION_MARK Start="x" Num="1"/><POSITION_MARK Start="10.5" Num="8"/>').otherwise("")
    xml = F.concat(F.lit('<TRACK TrackID="'), text(p), F.lit('"'), where, F.lit(' AverageBpm="'), bpm, F.lit('" Tonality="'), key, F.lit('">'), marks, F.lit("</TRACK>"))
    rows = v.tracks.select(F.from_xml(xml, L.TRACK_XML).alias("t")).select("t.*")
    cues = F.col("cue_points")
    return L.collection(rows).select("location", "bpm", "key", F.size(cues).alias("n_cues"), F.get(cues, F.lit(0))["position_ms"].alias("first_ms"), F.get(cues, F.lit(0))["type"].alias("first_type"))


@query("SELECT user_id AS pos, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def cache_upsert_latest(v: Views):
    return L.latest(v.table("events").select(F.col("user_id").alias("pos"), "event_type", "value", "event_id"), "pos", "event_id")


@query("SELECT pos, mood, prob FROM (SELECT pos, unnest(['calm', 'dark', 'warm']) AS mood, unnest([round(rms_energy, 4), round(brightness, 4), round(onset_strength, 4)]) AS prob FROM features)")
def moods_json(v: Views):
    """Moods to JSON and back, as the cache stores them."""
    mood = lambda name, c: F.struct(F.lit(name).alias("mood"), F.round(c, 4).alias("prob"))
    text = F.to_json(F.array(mood("calm", "rms_energy"), mood("dark", "brightness"), mood("warm", "onset_strength")))
    back = F.from_json(text, "array<struct<mood:string,prob:double>>")
    return v.features.select("pos", F.explode(back).alias("m")).select("pos", "m.mood", "m.prob")


@query("""WITH raw AS (SELECT pos, path, CASE WHEN pos % 5 = 0 THEN NULL ELSE bpm END AS bpm, CASE WHEN pos % 3 = 1 THEN '' ELSE '8B' END AS key, CASE WHEN pos % 2 = 0 THEN 2 ELSE 0 END AS cues FROM tracks WHERE pos % 4 <> 0)
SELECT count(*) AS tracks, count(bpm) AS with_bpm, CAST(sum(CASE WHEN key <> '' THEN 1 ELSE 0 END) AS BIGINT) AS with_key, CAST(sum(cues) AS BIGINT) AS cues FROM raw""")
def import_summary(v: Views):
    p = F.col("pos")
    rows = v.tracks.where(p % 4 != 0).select(F.when(p % 5 != 0, F.col("bpm")).alias("bpm"), F.when(p % 3 == 1, "").otherwise("8B").alias("key"), F.when(p % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("cues"))
    return rows.agg(F.count("*").alias("tracks"), F.count("bpm").alias("with_bpm"), F.sum((F.col("key") != "").cast("long")).alias("with_key"), F.sum(F.size("cues")).alias("cues"))


def _numpy_file(batches):
    """(path, content): each vector as a numpy file, as a square by rows or by columns, single or double."""
    for batch in batches:
        rows = []
        for k, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            out = io.BytesIO()
            kind, order = (np.float32, np.float64)[k % 2], "CF"[k // 2 % 2]
            np.lib.format.write_array(out, np.asarray(np.array(x, kind).reshape(8, -1), order=order))
            rows.append((str(k), out.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(CAST(embedding[2] AS DOUBLE), 6) AS second, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) % 8 = 0 AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0")
def npy_vectors(v: Views):
    """Vectors that went through numpy files of four layouts."""
    good = v.table("embeddings").where("embedding IS NOT NULL AND size(embedding) % 8 = 0 AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    files = good.select("vec_id", "embedding").mapInArrow(_numpy_file, "path string, content binary")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return npy.vectors(files).select(F.col("path").cast("long").alias("vec_id"), F.size("vector").cast("long").alias("n"), F.round(F.get("vector", F.lit(1)), 6).alias("second"), F.round(total, 6).alias("total"))


def _sqlite_library(v: Views) -> str:
    """A fresh library file in the shared folder, with the known locations."""
    folder = sqlite_source.local(v.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="segue-sqlite-"))
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"library-{uuid.uuid4().hex}.sqlite")
    con = sqlite3.connect(path)
    with con:
        con.execute("CREATE TABLE track_locations (id INTEGER PRIMARY KEY, location TEXT UNIQUE, fs_deleted INTEGER)")
        con.execute("CREATE TABLE crates (id INTEGER PRIMARY KEY, name TEXT UNIQUE)")
        con.execute("CREATE TABLE crate_tracks (crate_id INTEGER, track_id INTEGER, PRIMARY KEY (crate_id, track_id))")
        con.execute("CREATE TABLE cues (id INTEGER PRIMARY KEY, track_id INTEGER, type INTEGER, position INTEGER, length INTEGER, hotcue INTEGER, label TEXT)")
    con.close()
    sqlite_source.put(v.track_locations, path, "track_locations")
    return path


@query("SELECT 'Set 1' AS crate, o_orderkey AS track_id FROM orders WHERE o_custkey % 20 = 1")
def sqlite_crate(v: Views):
    """A crate that was written, written anew with fewer tracks, and read back."""
    path = _sqlite_library(v)
    for last in (2, 1):
        wanted = v.table("orders").where(f"o_custkey % 20 BETWEEN 1 AND {last}").select(F.concat(F.lit("/music/o"), F.col("o_orderkey").cast("string")).alias("location"))
        sqlite_source.write_crate(v.spark, path, "Set 1", wanted)
    crates = sqlite_source.table(v.spark, path, "crates").select(F.col("id").alias("crate_id"), F.col("name").alias("crate"))
    return sqlite_source.table(v.spark, path, "crate_tracks", rows=1000).join(crates, "crate_id").select("crate", "track_id")


@query("SELECT t.id AS track_id, CAST(k + 4 AS INT) AS hotcue, concat('Cue ', CAST(k + 1 AS VARCHAR), ' Ms') AS label, trunc(ms / 1000.0::DOUBLE * 44100) AS position FROM (SELECT pos, k, CASE k WHEN 0 THEN intro_length_secs * 1000.5::DOUBLE ELSE rms_energy * 300000 END AS ms FROM features, (VALUES (0), (1)) v(k)) c JOIN track_locations t ON t.location = concat('/music/o', CAST(pos AS VARCHAR)) WHERE t.fs_deleted = 0")
def sqlite_cues(v: Views):
    """Hot cues that were written to the library file and read back."""
    path = _sqlite_library(v)
    both = F.array(F.struct(F.lit("cue_1_ms").alias("name"), (F.col("intro_length_secs") * 1000.5).alias("ms")), F.struct(F.lit("cue_2_ms").alias("name"), (F.col("rms_energy") * 300000).alias("ms")))
    cues = v.features.select(F.concat(F.lit("/music/o"), F.col("pos").cast("string")).alias("location"), F.posexplode(both).alias("slot", "c"))
    sqlite_source.write_cues(v.spark, path, cues.select("location", "slot", F.col("c.name").alias("name"), F.col("c.ms").alias("position_ms")))
    return sqlite_source.table(v.spark, path, "cues", rows=1000).select("track_id", "hotcue", "label", "position")
