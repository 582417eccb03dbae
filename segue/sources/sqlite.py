"""SQLite files as tables.

A file is read whole as one binary row, so any path that Spark can read will do,
and it is opened in memory by the task that has the row; many files are read in
parallel. Writing goes through a local file, as SQLite itself does.
"""

from __future__ import annotations

import os
import sqlite3
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are fetched at once.
FETCH = 10_000

#: Fixed: columns of the tables that are read, by table.
TABLES = {
    "intensity_features": "file_hash string, rms_energy double, brightness double, sub_bass_energy double, kick_energy double, bass_harmonics double, percussiveness double, onset_strength double",
    "track_moods": "file_hash string, moods_json string, primary_mood string",
    "track_locations": "id long, location string, fs_deleted int",
    "library": "id long, location long, rating int, timesplayed int, last_played_at string, samplerate int, mixxx_deleted int, bpm double",
    "cues": "track_id long, type int, position double, hotcue int, label string",
    "crates": "id long, name string",
    "crate_tracks": "crate_id long, track_id long",
}


#: Fixed: where a library's file is looked for, by platform, below the home folder (on Windows, the local data folder).
PLACES = {
    "linux": (".mixxx/mixxxdb.sqlite", ".var/app/org.mixxx.Mixxx/.mixxx/mixxxdb.sqlite"),
    "darwin": ("Library/Application Support/Mixxx/mixxxdb.sqlite",),
    "win32": ("Mixxx/mixxxdb.sqlite",),
}


def discover(home: str | None = None, platform: str = sys.platform) -> str | None:
    """The first library file that is there, or None."""
    root = home or (os.environ.get("LOCALAPPDATA") if platform == "win32" else os.path.expanduser("~"))
    found = (os.path.join(root, place) for place in PLACES.get(platform, ()) if root)
    return next((path for path in found if os.path.exists(path)), None)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    """A table of the files at a path. Columns that a file hasn't are null; a file without the table has no rows."""
    kind = StructType.fromDDL(schema or TABLES[table])
    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                con = sqlite3.connect(":memory:")
                con.deserialize(content.as_py())
                there = {r[1].lower() for r in con.execute(f"PRAGMA table_info({quoted(table)})")}
                if there:
                    cells = ", ".join(quoted(f.name) if f.name.lower() in there else "NULL" for f in arrow)
                    cursor = con.execute(f"SELECT {cells} FROM {quoted(table)}")
                    while some := cursor.fetchmany(FETCH):
                        yield pa.RecordBatch.from_arrays([pa.array([_as(x, f.type) for x in c], f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], arrow.names)
                con.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, kind)


def _as(x: object, kind: pa.DataType) -> object:
    """A cell as its column's kind; null where it can't be."""
    if x is None:
        return None
    try:
        return str(x) if pa.types.is_string(kind) else float(x) if pa.types.is_floating(kind) else int(x)
    except (TypeError, ValueError):
        return None


def upsert(path: str, table: str, rows: DataFrame, key: str) -> int:
    """Puts rows into a table of a local file, in place of those of the same key; makes both where missing.

    Rows come to the driver a partition at a time. All or none are put.
    """
    con = sqlite3.connect(path)
    try:
        kinds = {"string": "TEXT", "double": "REAL", "float": "REAL"}
        columns = ", ".join(f"{quoted(c)} {kinds.get(t, 'INTEGER')}{' PRIMARY KEY' if c == key else ''}" for c, t in rows.dtypes)
        con.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns})")
        into = f"INSERT OR REPLACE INTO {quoted(table)} ({', '.join(map(quoted, rows.columns))}) VALUES ({', '.join('?' * len(rows.columns))})"
        n = 0
        with con:
            for row in rows.toLocalIterator():
                con.execute(into, tuple(row))
                n += 1
        return n
    finally:
        con.close()


def clear(path: str, *tables: str) -> None:
    """Takes all rows out of tables of a local file, those that it has."""
    con = sqlite3.connect(path)
    try:
        there = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        with con:
            for table in tables:
                if table in there:
                    con.execute(f"DELETE FROM {quoted(table)}")
    finally:
        con.close()
