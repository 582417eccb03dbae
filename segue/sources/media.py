"""Tags of audio files, read from the files' own bytes: ID3v2, Vorbis comments of FLAC, and RIFF INFO.

A file is one binary row; only its tag blocks are parsed, no audio is decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions import exprs as X

#: Fixed: the fields' names in each kind of tag.
NAMES = {
    "artist": ("artist", "TPE1", "IART"),
    "title": ("title", "TIT2", "INAM"),
    "album": ("album", "TALB", "IPRD"),
    "genre": ("genre", "TCON", "IGNR"),
    "date": ("date", "year", "TDRC", "TYER", "ICRD"),
    "mood": ("mood", "TMOO", "vibe"),
    "bpm": ("bpm", "TBPM", "tempo"),
}

#: Fixed: codecs of ID3 text by its first byte.
CODECS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def synchsafe(x: bytes) -> int:
    return x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]


def id3(data: bytes) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag at the beginning; user texts by their description."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}
    version, flags = data[3], data[5]
    end = min(len(data), 10 + synchsafe(data[6:10]))
    body = data[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at, found = 0, {}
    if flags & 0x40 and len(body) >= 4:
        at = synchsafe(body[:4]) if version >= 4 else 4 + struct.unpack(">I", body[:4])[0]
    while at + 10 <= len(body) and body[at : at + 4].strip(b"\0"):
        name = body[at : at + 4].decode("latin-1")
        size = synchsafe(body[at + 4 : at + 8]) if version >= 4 else struct.unpack(">I", body[at + 4 : at + 8])[0]
        frame = body[at + 10 : at + 10 + size]
        at += 10 + size
        if not name.startswith("T") or not frame or frame[0] >= len(CODECS):
            continue
        texts = [t.strip("﻿") for t in frame[1:].decode(CODECS[frame[0]], "replace").split("\0")]
        if name == "TXXX" and len(texts) > 1:
            name, texts = texts[0], texts[1:]
        if texts[0]:
            found.setdefault(name, texts[0])
    return found


def flac(data: bytes) -> tuple[dict[str, str], float | None]:
    """Vorbis comments and seconds of a FLAC file."""
    at, found, seconds, last = 4, {}, None, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(block) >= 18:
            bits = int.from_bytes(block[10:18], "big")
            rate, samples = bits >> 44, bits & ((1 << 36) - 1)
            seconds = samples / rate if rate else None
        elif kind == 4:
            (spot,) = struct.unpack_from("<I", block)
            (n,) = struct.unpack_from("<I", block, 4 + spot)
            spot += 8
            for _ in range(n):
                (length,) = struct.unpack_from("<I", block, spot)
                name, _, text = block[spot + 4 : spot + 4 + length].decode("utf-8", "replace").partition("=")
                spot += 4 + length
                found.setdefault(name.lower(), text)
    return found, seconds


def riff(data: bytes) -> tuple[dict[str, str], float | None]:
    """INFO texts and seconds of a WAV file; an ID3 chunk's texts too."""
    at, found, rate, size_of_data = 12, {}, 0, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunk = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
        if name == b"fmt " and len(chunk) >= 12:
            (rate,) = struct.unpack_from("<I", chunk, 8)
        elif name == b"data":
            size_of_data = len(chunk)
        elif name in (b"id3 ", b"ID3 "):
            found |= id3(chunk)
        elif name == b"LIST" and chunk[:4] == b"INFO":
            spot = 4
            while spot + 8 <= len(chunk):
                length = struct.unpack_from("<I", chunk, spot + 4)[0]
                found.setdefault(chunk[spot : spot + 4].decode("latin-1"), chunk[spot + 8 : spot + 8 + length].split(b"\0")[0].decode("utf-8", "replace"))
                spot += 8 + length + length % 2
    return found, size_of_data / rate if rate and size_of_data is not None else None


def tags_of(data: bytes) -> tuple[dict[str, str | None], float | None]:
    """The fields of ``NAMES`` and the seconds, where the file tells; an unknown kind of file is an error."""
    seconds = None
    if data[:4] == b"fLaC":
        raw, seconds = flac(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        raw, seconds = riff(data)
    elif data[:3] == b"ID3":
        raw = id3(data)
    else:
        raise ValueError("no tags of a known kind")
    low = {k.lower(): v for k, v in raw.items()}
    return {field: next((low[n.lower()] for n in names if low.get(n.lower())), None) for field, names in NAMES.items()}, seconds


READ = "path string, artist string, title string, album string, genre string, date string, mood string, bpm_text string, duration double, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                fields, seconds = tags_of(content.as_py())
                rows.append((path, *(fields[k] for k in ("artist", "title", "album", "genre", "date", "mood", "bpm")), seconds, None))
            except (ValueError, IndexError, struct.error) as e:
                rows.append((path, *[None] * 8, str(e)))
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.float64() if x == "duration" else pa.string() for x in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_tags(spark: SparkSession, *folders: str) -> DataFrame:
    """One row for each audio file below some folders: its tags, tempo and year parsed, and what went wrong, if anything.

    A file without readable tags has a row too, with nulls and the error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    read = files.where(X.suffix("path").isin(*X.AUDIO_EXTENSIONS)).select("path", "content").mapInArrow(_read, READ)
    return read.withColumn("bpm", X.parse_bpm(F.col("bpm_text"))).withColumn("year", X.parse_year(F.col("date"))).drop("bpm_text", "date")


def batch_eta(files: DataFrame, seconds_each: float = 2.0, at_once: int = 1) -> DataFrame:
    """How many files there are to analyse, and about how many seconds that takes."""
    n = F.count("*")
    return files.agg(n.alias("files"), (F.ceil(n / at_once) * seconds_each).cast("double").alias("seconds"))
