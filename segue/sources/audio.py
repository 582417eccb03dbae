"""Audio features from WAV and FLAC files: a source of feature rows.

Files are read by Spark as binary rows and analysed in their tasks with numpy;
a file that can't be read, and one of another kind, gives a row with its error. Features have the ranges
of the feature table; filters and transforms are plain textbook ones, so values
are close to, not equal with, those of other audio libraries.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions import exprs as X
from segue.sources import beats, flac

RATE, WINDOW, HOP, SECONDS = 22050, 2048, 512, 300
NAMES = (
    "rms_energy", "brightness", "sub_bass_energy", "kick_energy", "bass_harmonics", "percussiveness", "onset_strength", "dynamic_range", "energy_gradient", "drop_density",
    "spectral_flatness", "zero_crossing_rate", "mfcc_variance", "spectral_rolloff_85", "vocal_presence", "intro_length_secs",
)
SCHEMA = "path string, file_hash string, " + ", ".join(f"{n} double" for n in NAMES) + ", camelot_key string, error string"


#: What a file that can't be read raises.
UNREADABLE = (wave.Error, EOFError, ValueError)


def read_wav(content: bytes) -> np.ndarray:
    """Mono samples at RATE, of the first SECONDS of a WAV file."""
    with wave.open(io.BytesIO(content)) as f:
        rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
        raw = f.readframes(min(f.getnframes(), rate * SECONDS))
    if width == 1:
        y = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        y = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8) / float(1 << 23)
    else:
        y = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return _mono(y.reshape(-1, channels), rate)


def read_flac(content: bytes) -> np.ndarray:
    """Mono samples at RATE, of the first SECONDS of a FLAC file."""
    y, about = flac.decode(content, SECONDS)
    return _mono(y / float(1 << (about.bits - 1)), about.rate)


def _mono(y: np.ndarray, rate: int) -> np.ndarray:
    y = y.mean(axis=1) if len(y) else np.empty(0)
    if not len(y):
        raise ValueError("no samples")
    if rate != RATE:
        n = max(1, int(len(y) * RATE / rate))
        y = np.interp(np.arange(n) * rate / RATE, np.arange(len(y)), y)
    return y


def read_samples(content: bytes) -> np.ndarray:
    """Mono samples at RATE of a file, told by its first bytes."""
    if content[:4] == b"RIFF":
        return read_wav(content)
    if content[:4] == b"fLaC":
        return read_flac(content)
    raise ValueError("no decoder for this kind of file")


def frames_of(y: np.ndarray) -> np.ndarray:
    padded = np.pad(y, WINDOW // 2)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]


def _median(s: np.ndarray, axis: int, width: int = 31) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (width // 2, width // 2)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(s, pad, mode="reflect" if s.shape[axis] > width // 2 else "edge"), width, axis=axis)
    step = 1024  # frames at a time, as a median holds all windows it looks at
    return np.concatenate([np.median(windows[:, at : at + step], axis=-1) for at in range(0, s.shape[1], step)], axis=1)


def tempo(y: np.ndarray) -> float | None:
    """Whole beats a minute of the first minute; null for silence and scraps."""
    bpm, _ = beats.beats(y[: 60 * RATE])
    return float(round(bpm)) if bpm and round(bpm) > 0 else None


def _share(s: np.ndarray, hz: np.ndarray, lo: float, hi: float) -> float:
    whole = s[(hz >= 20) & (hz < 250)].mean()
    part = s[(hz >= lo) & (hz < hi)]
    return float(np.clip(part.mean() / whole, 0, 1)) if whole > 0 and part.size else 0.0


def analyse(y: np.ndarray) -> dict:
    """All features of one track's samples."""
    clip = lambda x: float(np.clip(x, 0, 1))
    cut = frames_of(y)
    rms = np.sqrt((cut**2).mean(axis=1))
    s = np.abs(np.fft.rfft(cut * np.hanning(WINDOW), axis=1)).T
    hz = np.fft.rfftfreq(WINDOW, 1 / RATE)
    total = s.sum(axis=0)
    centroid = (hz[:, None] * s).sum(axis=0) / np.maximum(total, 1e-12)
    loud = rms > np.percentile(rms, 25)
    bright = (centroid[loud] * rms[loud]).sum() / rms[loud].sum() if loud.any() else centroid.mean()
    steady, struck = _median(s, 1), _median(s, 0)
    mask = struck**2 / np.maximum(steady**2 + struck**2, 1e-12)
    norm = lambda x: np.sqrt((x**2).mean())
    power = s**2 + 1e-10
    mel = np.log(beats.mel(40, WINDOW) @ power + 1e-10)
    k = np.arange(mel.shape[0])
    dct = np.cos(np.pi * np.arange(13)[:, None] * (2 * k + 1) / (2 * len(k))) * np.sqrt(2 / len(k))
    upto = np.cumsum(s, axis=0)
    rolloff = hz[(upto >= 0.85 * np.maximum(upto[-1], 1e-12)).argmax(axis=0)]
    voice = (hz >= 200) & (hz < 800)
    steady_part = s * (1 - mask)
    slope = np.polyfit(np.arange(len(rms)), rms, 1)[0] if len(rms) > 1 else 0.0
    minutes = len(rms) * HOP / (RATE * 60)
    over = np.flatnonzero(rms > 0.5 * rms.mean())
    pitch = np.zeros((12, len(hz)))
    heard = hz >= 27.5
    pitch[np.round(12 * np.log2(hz[heard] / 261.6256)).astype(int) % 12, np.flatnonzero(heard)] = 1
    chroma = pitch @ s
    chroma = (chroma / np.maximum(chroma.max(axis=0), 1e-12)).mean(axis=1)
    clear = chroma.std() >= 0.015 and chroma.max() >= 1.5 * chroma.mean()
    return {
        "rms_energy": clip(rms.mean() / 0.3), "brightness": clip(bright / (RATE / 2)), "sub_bass_energy": _share(s, hz, 20, 60), "kick_energy": _share(s, hz, 60, 120), "bass_harmonics": _share(s, hz, 120, 250),
        "percussiveness": clip(norm(s * mask) / max(norm(s), 1e-12)), "onset_strength": clip(np.maximum(0, np.diff(s, axis=1)).mean() / 10 if s.shape[1] > 1 else 0),
        "dynamic_range": clip((rms.max() - rms.min()) / (0.3 + 1e-9)), "energy_gradient": float(np.clip(slope, -0.001, 0.001) / 0.001), "drop_density": clip((rms > rms.mean() + 2 * rms.std()).sum() / minutes / 10),
        "spectral_flatness": clip((np.exp(np.log(power).mean(axis=0)) / power.mean(axis=0)).mean()), "zero_crossing_rate": clip((np.diff(np.signbit(y)) != 0).mean() / 0.5 if len(y) > 1 else 0),
        "mfcc_variance": clip((dct @ mel).var(axis=1).mean() / 100), "spectral_rolloff_85": clip(rolloff.mean() / (RATE / 2)), "vocal_presence": clip(steady_part[voice].sum() / (steady_part.sum() + 1e-9) * 10),
        "intro_length_secs": float(over[0] * HOP / RATE) if len(over) else 0.0, "camelot_key": X.CHROMA_CAMELOT[int(chroma.argmax())] if clear else None,
    }


def _analyse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, file_hash, content in zip(batch.path, batch.file_hash, batch.content, strict=True):
            row = {"path": path, "file_hash": file_hash, "error": None}
            try:
                row |= analyse(read_samples(bytes(content)))
            except UNREADABLE as problem:
                row["error"] = f"{type(problem).__name__}: {problem}"
            rows.append(row)
        yield pd.DataFrame(rows, columns=["path", "file_hash", *NAMES, "camelot_key", "error"]).astype({c: object for c in ("path", "file_hash", "camelot_key", "error")})


def _tempo_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.path, batch.content, strict=True):
            try:
                rows.append((path, tempo(read_samples(bytes(content)))))
            except UNREADABLE:
                rows.append((path, None))
        yield pd.DataFrame(rows, columns=["path", "bpm"]).astype({"path": object, "bpm": "Float64"})


def tempos_of(files: DataFrame) -> DataFrame:
    """(path, bpm) of files (path, content): the estimated tempo; null where there is none, no sound, or no decoder."""
    return files.where(X.suffix("path").isin(*X.AUDIO_EXTENSIONS)).select("path", "content").mapInPandas(_tempo_files, "path string, bpm double")


def tempos(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bpm): the estimated tempo of the audio files below a folder."""
    return tempos_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def hashed(files: DataFrame) -> DataFrame:
    """(path, file_hash, content) of audio files; the hash is the MD5 of the first MiB."""
    return files.where(X.suffix("path").isin(*X.AUDIO_EXTENSIONS)).select("path", F.md5(F.substring("content", 1, 1 << 20)).alias("file_hash"), "content")


def analysed(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Feature rows of hashed files; those whose hash is in the cache are not analysed again."""
    if cache is None:
        return files.mapInPandas(_analyse_files, SCHEMA)
    known = cache.where("error IS NULL" if "error" in cache.columns else "true").dropDuplicates(["file_hash"])
    hits = files.select("path", "file_hash").join(known.select("file_hash", *NAMES, "camelot_key"), "file_hash").select("path", "file_hash", *NAMES, "camelot_key", F.lit(None).cast("string").alias("error"))
    misses = files.join(known.select("file_hash"), "file_hash", "left_anti").select("path", "file_hash", "content")
    return hits.unionByName(misses.mapInPandas(_analyse_files, SCHEMA))


def features(spark: SparkSession, folder: str, cache: DataFrame | None = None) -> DataFrame:
    """Feature rows of the audio files below a folder, one per path; what can't be decoded has nulls and the error.

    ``cache`` has rows of earlier runs by file_hash (MD5 of the first MiB);
    files that it has without an error are not analysed again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return analysed(hashed(files), cache)
