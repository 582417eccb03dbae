"""SQLite files with commit and abort, numpy caches, folder overrides, folders that are followed."""

import io
import json
import os
import sqlite3
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue import cli
from segue.api import Library
from segue.sources import config, npy
from segue.sources import sqlite_source as S
from segue.streaming import analysis

sys.path.insert(0, os.path.dirname(__file__))
from flac_writer import encode  # noqa: E402


def rows_of(path, sql):
    con = sqlite3.connect(path)
    try:
        return con.execute(sql).fetchall()
    finally:
        con.close()


def test_sqlite_rows_by_ranges(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    con = sqlite3.connect(path)
    with con:
        con.execute("CREATE TABLE cues (track_id INTEGER, hotcue, label TEXT)")
        con.executemany("INSERT INTO cues VALUES (?, ?, ?)", [(k, k % 3 if k % 5 else "x", f"c{k}") for k in range(1000)])
        con.execute("DELETE FROM cues WHERE track_id BETWEEN 200 AND 700")
        con.execute("CREATE TABLE crates (id INTEGER, name TEXT)")
    con.close()
    got = S.table(spark, path, "cues", rows=64)
    assert got.rdd.getNumPartitions() == 16
    want = [(k, None, None, k % 3 if k % 5 else None, f"c{k}") for k in range(1000) if not 200 <= k <= 700]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert S.table(spark, f"file://{path}", "crates").collect() == [] and S.table(spark, path, "library").collect() == []
    with pytest.raises(ValueError, match="files"):
        S.local("viewfs://store/a.sqlite")


def test_sqlite_writes_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "b.sqlite")
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("name"), (F.col("id") * 1.5).alias("x"), "id").repartition(20)
    S.put(rows, path, "t", key="name")
    S.put(rows.where("id < 10").withColumn("x", F.lit(-1.0)), path, "t")
    assert rows_of(path, "SELECT count(*), sum(x < 0), count(DISTINCT name) FROM t") == [(500, 10, 500)]
    before = rows_of(path, "SELECT * FROM t ORDER BY name")
    with pytest.raises(Exception):  # noqa: B017
        S.put(rows.withColumn("x", F.when(F.col("id") == 450, F.raise_error(F.lit("no"))).otherwise(F.col("x") + 1)), path, "t")
    assert rows_of(path, "SELECT * FROM t ORDER BY name") == before
    with pytest.raises(Exception):  # noqa: B017
        S.put(rows.withColumnRenamed("x", "no_such_column"), path, "t", overwrite=True)
    assert rows_of(path, "SELECT * FROM t ORDER BY name") == before and os.listdir(tmp_path) == ["b.sqlite"]
    S.put(rows.where("id < 3"), path, "t", overwrite=True)
    assert rows_of(path, "SELECT name FROM t ORDER BY name") == [("k0",), ("k1",), ("k2",)]
    S.put(spark.createDataFrame([("k9", 1.0, 2)], "name string, x double, id long"), path, "t", replace="id")
    assert rows_of(path, "SELECT name FROM t ORDER BY name") == [("k0",), ("k1",), ("k9",)]


def test_npy_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    for kind in ("<f4", ">f8", "<i2", "|b1", "<u8"):
        for shape in ((), (5,), (3, 4), (0, 2)):
            for order in "CF":
                x = np.asarray(rng.integers(0, 2, shape).astype(kind), order=order)
                out = io.BytesIO()
                np.save(out, x)
                got = npy.parse(out.getvalue())
                assert got[0] == shape and np.array_equal(got[1], x.ravel().astype(float))
    out = io.BytesIO()
    np.save(out, np.array(["a"]))
    good = io.BytesIO()
    np.save(good, np.arange(4, dtype=np.float32))
    for bad in (b"", b"\x93NUMPY", out.getvalue(), good.getvalue()[:-1], good.getvalue()[:40], good.getvalue().replace(b"descr", b"scrde")):
        with pytest.raises(ValueError):
            npy.parse(bad)
    files = {"a.npy": good.getvalue(), "a_metadata.json": json.dumps({"top_tags": [["techno", 0.9]], "moods": [["dark", 0.25], ["calm", 0.5]]}), "a_tags.json": "[]", "b.npy": good.getvalue(), "b_tags.json": json.dumps([["old", 1]]),
             "c.npy": good.getvalue(), "d.npy": good.getvalue()[:20], "d_metadata.json": "{}", "e.npy": good.getvalue(), "e_metadata.json": "{not json"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    got = {r.file_hash: r for r in npy.cache(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    assert got["a"].embedding == [0, 1, 2, 3] and [tuple(p) for p in got["a"].top_tags] == [("techno", 0.9)] and [tuple(p) for p in got["a"].moods] == [("dark", 0.25), ("calm", 0.5)]
    assert [tuple(p) for p in got["b"].top_tags] == [("old", 1.0)] and got["b"].moods == [] and got["b"].error is None
    assert got["d"].embedding is None and "cut short" in got["d"].error and "labels" in got["e"].error


def test_folder_overrides(tmp_path):
    path, music = str(tmp_path / "deep" / "settings.yaml"), str(tmp_path / "music")
    assert config.folder_override(path, music) == {"first": None, "last": None}
    config.set_folder_override(path, music, first="/a.flac")
    config.set_folder_override(path, music + "/", last="/b.flac")
    config.set_folder_override(path, str(tmp_path), first="/c.flac")
    assert config.folder_override(path, music) == {"first": "/a.flac", "last": "/b.flac"}
    config.clear_folder_override(path, music)
    config.clear_folder_override(path, music)
    assert config.folder_override(path, music)["first"] is None and config.folder_override(path, str(tmp_path))["first"] == "/c.flac"


def sound(path, hz=440, bpm=None, seconds=3.0):
    t = np.arange(int(22050 * seconds)) / 22050
    y = 0.3 * np.sin(2 * np.pi * hz * t)
    if bpm:
        y = y * 0.05 + 0.9 * np.exp(-60 * (t % (60 / bpm))) * np.sin(2 * np.pi * 1500 * t)
    x = np.round(y * 30000).astype("<i2")
    if path.suffix == ".flac":
        path.write_bytes(encode(x.astype(np.int64)[:, None], block=4096, comments=(f"TITLE={path.stem}", f"ARTIST={path.stem[0]}", *([f"BPM={bpm}"] if hz > 500 else []))))
        return
    with wave.open(str(path), "wb") as f:
        f.setparams((1, 2, 22050, 0, "NONE", ""))
        f.writeframes(x.tobytes())


def test_folder_that_goes_on(spark, tmp_path, monkeypatch):
    music, out, check = tmp_path / "music", str(tmp_path / "out"), str(tmp_path / "check")
    music.mkdir()
    for k in range(3):
        sound(music / f"a{k}.wav", 300 + 100 * k, seconds=0.5)
    (music / "bad.flac").write_bytes(b"fLaC but no more")
    (music / "note.txt").write_bytes(b"no sound")
    calls = []
    write = analysis._write

    def stops(rows, folder, batch, again):
        write(rows, folder, batch, again)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("the machine is gone")

    monkeypatch.setattr(analysis, "_write", stops)
    with pytest.raises(Exception, match="machine is gone"):
        analysis.follow(spark, str(music), out, check, files_a_batch=2).awaitTermination()
    analysis.follow(spark, str(music), out, check, files_a_batch=2).awaitTermination()
    found = analysis.results(spark, out).toPandas()
    names = found.path.str.rpartition("/")[2]
    assert sorted(names) == ["a0.wav", "a1.wav", "a2.wav", "bad.flac"] and found.error.notna().sum() == 1
    # a copy takes the row of the file that it is a copy of; a file changed behind the scan's back is read again on demand
    (music / "copy.wav").write_bytes((music / "a0.wav").read_bytes())
    monkeypatch.undo()
    analysis.follow(spark, str(music), out, check).awaitTermination()
    rows = {r.path.rpartition("/")[2]: r for r in analysis.latest(spark, out).collect()}
    assert len(rows) == 5 and rows["copy.wav"].brightness == rows["a0.wav"].brightness
    sound(music / "a1.wav", 4000, seconds=0.5)
    analysis.follow(spark, str(music), out, check).awaitTermination()
    assert {r.path.rpartition("/")[2]: r for r in analysis.latest(spark, out).collect()}["a1.wav"].brightness == rows["a1.wav"].brightness
    analysis.again(spark, [str(music / "a1.wav")], out)
    analysis.again(spark, [str(music / "a2.wav")], out)
    last = {r.path.rpartition("/")[2]: r for r in analysis.latest(spark, out).collect()}
    assert last["a1.wav"].brightness > 2 * rows["a1.wav"].brightness and last["a2.wav"].again > last["a1.wav"].again and len(last) == 5


def test_folder_to_playlists(spark, tmp_path, capsys, monkeypatch):
    music = tmp_path / "music"
    (music / "sub").mkdir(parents=True)
    for k in range(4):
        sound(music / f"a{k}.flac", 200 + 10 * k, bpm=120)
        sound(music / "sub" / f"b{k}.flac", 2000 + 100 * k, bpm=150)
    sound(music / "c.wav", 220, bpm=120)
    (music / "bad.mp3").write_bytes(b"no sound")
    lib, failed = Library.from_folders(spark, str(music))
    tracks = {r.path.rpartition("/")[2]: r for r in lib.tracks.collect()}
    assert len(tracks) == 9 and len({r.pos for r in tracks.values()}) == 9 and [r.path.rpartition("/")[2] for r in failed.collect()] == ["bad.mp3"]
    assert tracks["b1.flac"].bpm == 150 and tracks["b1.flac"].title == "b1" and abs(tracks["a0.flac"].bpm - 120) <= 1 and abs(tracks["a0.flac"].duration - 3) < 0.01
    monkeypatch.setattr(cli, "local_session", lambda *a, **k: spark)
    out, cache = tmp_path / "out", str(tmp_path / "cache")
    for _ in range(2):
        assert cli.main(["scan", str(music), "--clusters", "2", "--cache", cache, "--intro", "short", "--out", str(out)]) == 0
        said = capsys.readouterr()
        assert said.out.count("tracks)") == 2 and "bad.mp3" in said.err
    assert spark.read.parquet(cache).count() == 9
    lines = [r.value for r in spark.read.text(str(out), recursiveFileLookup=True).collect()]
    assert lines.count("#EXTM3U") == 2 and sum(x.startswith("#EXTINF") for x in lines) == 9
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.mp3").write_bytes(b"x")
    assert cli.main(["scan", str(empty)]) == 1
