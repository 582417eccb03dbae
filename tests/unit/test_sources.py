"""Audio, YAML and crate sources on small made files."""

import io
import wave

import numpy as np

from segue.operators import playlists
from segue.sources import audio, config, media, sqlite
from segue.sources import library as L


def wav(y, rate=22050, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def tone(hz, seconds=2.0, rate=22050, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def test_features_of_tones():
    low, high = audio.analyse(audio.read_wav(wav(tone(80)))), audio.analyse(audio.read_wav(wav(tone(5000))))
    assert high["brightness"] > 0.4 > low["brightness"] and high["zero_crossing_rate"] > low["zero_crossing_rate"]
    assert low["kick_energy"] == 1 and low["rms_energy"] == 1 and low["percussiveness"] < 0.3
    noise = audio.analyse(np.random.default_rng(0).normal(0, 0.1, 44100))
    assert noise["spectral_flatness"] > 10 * high["spectral_flatness"]
    assert audio.analyse(audio.read_wav(wav(tone(440))))["camelot_key"] == audio.X.CHROMA_CAMELOT[9]
    quiet = audio.analyse(np.concatenate([np.zeros(22050), tone(440)]))
    assert 0.7 < quiet["intro_length_secs"] < 1.1 and quiet["dynamic_range"] == 1
    assert all(-1 <= v <= 1 for k, v in noise.items() if k not in ("camelot_key", "intro_length_secs"))


def test_tempo(spark, tmp_path):
    for bpm in (90, 120, 140, 174):
        y, rng = np.zeros(audio.RATE * 20), np.random.default_rng(0)
        for t in np.arange(0, 19.5, 60 / bpm):
            y[int(t * audio.RATE) :][:1500] += rng.normal(0, 0.3, 1500) * np.exp(-np.arange(1500) / 300)
        assert abs(audio.tempo(y) - bpm) <= 1
    (tmp_path / "a.wav").write_bytes(wav(y))
    (tmp_path / "b.wav").write_bytes(b"not audio")
    found = {r.path.rsplit("/", 1)[-1]: r.bpm for r in audio.tempos(spark, str(tmp_path)).collect()}
    assert abs(found["a.wav"] - 174) <= 1 and found["b.wav"] is None
    assert audio.tempo(np.zeros(5000)) is None and audio.tempo(np.ones(50)) is None


def test_library_is_found(tmp_path):
    assert sqlite.discover(str(tmp_path), "linux") is None and sqlite.discover(str(tmp_path), "plan9") is None
    for place in reversed(sqlite.PLACES["linux"]):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(b"")
        assert sqlite.discover(str(tmp_path), "linux") == str(tmp_path / place)


def test_stereo_and_rate():
    y = np.repeat(tone(100, rate=44100), 2)
    assert abs(len(audio.read_wav(wav(y, rate=44100, channels=2))) - 44100) <= 1


def test_folder_with_cache(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(tone(100)))
    (tmp_path / "b.WAV").write_bytes(b"not audio")
    (tmp_path / "c.mp3").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in audio.features(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.wav", "b.WAV", "c.mp3"} and rows["a.wav"].error is None and rows["b.WAV"].error and rows["c.mp3"].error
    cache = spark.createDataFrame([rows["a.wav"]], audio.SCHEMA).withColumn("rms_energy", audio.F.lit(0.125))
    again = {r.path.rsplit("/", 1)[-1]: r for r in audio.features(spark, str(tmp_path), cache).collect()}
    assert again["a.wav"].rms_energy == 0.125 and again["b.WAV"].error


def test_yaml(tmp_path):
    (tmp_path / "g.yaml").write_text("manual_assignments:\n  a.mp3: ' Techno '\n  b.mp3: polka\n  3: house\n")
    assert config.genre_map(str(tmp_path / "g.yaml")) == {"a.mp3": "techno"}
    (tmp_path / "w.yaml").write_text("weights: {bpm: 1, brightness: null}")
    assert config.weight_overrides(str(tmp_path / "w.yaml")) == {"bpm": 1.0}
    (tmp_path / "bad.yaml").write_text("{")
    assert config.settings(str(tmp_path / "bad.yaml"), {"a": 1}) == {"a": 1} and config.genre_map("/nowhere") == {}


def test_crates_and_upsert(spark):
    tracks = spark.createDataFrame([(1, 10), (2, 11)], "crate_id long, track_id long")
    places = spark.createDataFrame([(20, "/a"), (21, "/b")], "id long, location string")
    wanted = spark.createDataFrame([("/a",), ("/x",), ("/a",)], "location string")
    assert sorted(map(tuple, L.replace_crate(tracks, 1, places, wanted).collect())) == [(1, 20), (2, 11)]
    new = spark.createDataFrame([(2, 99), (3, 12)], "crate_id long, track_id long")
    assert sorted(map(tuple, L.upsert(tracks, new, "crate_id").collect())) == [(1, 10), (2, 99), (3, 12)]
    rows = spark.createDataFrame([(60.0,), (None,)], "duration double")
    assert playlists.single_chapter(rows).first()[:3] == ("Intro", 1.0, 1.0)


def id3(version=3, **frames):
    body = b""
    for name, text in frames.items():
        raw = b"\x03" + text.encode() if version == 4 else b"\x01" + text.encode("utf-16")
        size = len(raw)
        body += name.encode() + (bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) if version == 4 else size.to_bytes(4, "big")) + b"\0\0" + raw
    size = len(body) + 20
    return b"ID3" + bytes([version, 0, 0, size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + body + bytes(20) + b"audio"


def flac(seconds, **comments):
    info = bytes(10) + ((44100 << 44) | int(44100 * seconds)).to_bytes(8, "big") + bytes(16)
    texts = [f"{k}={v}".encode() for k, v in comments.items()]
    block = (4).to_bytes(4, "little") + b"made" + len(texts).to_bytes(4, "little") + b"".join(len(t).to_bytes(4, "little") + t for t in texts)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + len(block).to_bytes(3, "big") + block


def test_tags_of_files(spark, tmp_path):
    info = b"INFOIART" + (4).to_bytes(4, "little") + b"Ann\0" + b"INAM" + (3).to_bytes(4, "little") + b"Hi\0\0"
    made = wav(tone(100)) + b"LIST" + len(info).to_bytes(4, "little") + info
    (tmp_path / "a").mkdir()
    files = {"a/x.flac": flac(12.5, ARTIST="Ann", TITLE="Día", DATE="2019-05-01", BPM="128.5", vibe="dark"), "y.mp3": id3(3, TPE1="Bo", TIT2="Sí", TBPM="900", TYER="1999"), "z.MP3": id3(4, TIT2="Zed", TBPM="120"), "w.wav": made, "bad.mp3": b"nothing", "cut.flac": flac(1, ARTIST="A")[:60], "note.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in media.read_tags(spark, str(tmp_path)).collect()}
    assert set(got) == {"x.flac", "y.mp3", "z.MP3", "w.wav", "bad.mp3", "cut.flac"}
    x, y, z, w = (got[k] for k in ("x.flac", "y.mp3", "z.MP3", "w.wav"))
    assert (x.artist, x.title, x.year, x.bpm, x.mood, x.duration, x.error) == ("Ann", "Día", 2019, 128.5, "dark", 12.5, None)
    assert (y.artist, y.title, y.year, y.bpm) == ("Bo", "Sí", 1999, None) and (z.title, z.bpm) == ("Zed", 120.0)
    assert (w.artist, w.title) == ("Ann", "Hi") and abs(w.duration - 4) < 2.1
    assert got["bad.mp3"].error and got["cut.flac"].error
    eta = media.batch_eta(spark.range(7), at_once=2).first()
    assert (eta.files, eta.seconds) == (7, 8.0)


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache.db")
    columns = "file_hash string, rms_energy double, brightness double"
    assert sqlite.upsert(path, "intensity_features", spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.3, None)], columns), "file_hash") == 2
    assert sqlite.upsert(path, "intensity_features", spark.createDataFrame([("b", 0.5, 0.6), ("c", 0.7, 0.8)], columns), "file_hash") == 2
    got = {r.file_hash: (r.rms_energy, r.brightness, r.kick_energy) for r in sqlite.read(spark, path, "intensity_features").collect()}
    assert got == {"a": (0.1, 0.2, None), "b": (0.5, 0.6, None), "c": (0.7, 0.8, None)}
    assert sqlite.read(spark, path, "track_moods").count() == 0
    sqlite.clear(path, "intensity_features", "track_moods")
    assert sqlite.read(spark, path, "intensity_features").count() == 0


def test_json_is_saved_and_read(spark, tmp_path):
    path = str(tmp_path / "new" / "tags.json")
    rows = spark.createDataFrame([("b", ["x", "y"]), ("a", []), ("c", None), ('q"é', ["z"])], "path string, entry array<string>")
    assert L.save_json(rows, path) == 2
    assert {r.path: r.entry for r in L.json_store(spark, path, "array<string>").collect()} == {"b": ["x", "y"], 'q"é': ["z"]}
    assert L.save_json(rows.limit(0), path) == 0 and L.json_store(spark, path, "array<string>").count() == 0
    plays = spark.createDataFrame([("b", 2, "2024-01-01")], "path string, times_used int, last_used string")
    L.save_json(plays.select("path", L.F.struct("times_used", "last_used").alias("entry")), path)
    assert L.json_store(spark, path, "struct<times_used:int,last_used:string>").first().entry.times_used == 2
