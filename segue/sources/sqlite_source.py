"""SQLite files as a Spark data source, read in ranges of rows and written in one transaction.

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlite_table").option("path", f).option("table", "cues").schema("...").load()
    df.write.format("sqlite_table").option("path", f).option("table", "cues").option("replace", "track_id").mode("append").save()

A table is read by as many tasks as it has ranges of row numbers; each opens
the file for itself, so the file must lie where all tasks see it. Tasks write
files of their own, in a folder beside it. Only when all are written does the
commit put their rows into the table, SQLite reading file from file, all in one
transaction; an aborted write takes the folder away and leaves the table as it
was. A task that outlives the folder fails.

Options: ``path``, ``table``; for reading ``rows`` (row numbers of a range); for
writing ``key`` (the column that tells rows apart where the table is made by the
write) and ``replace`` (a column: old rows whose value is among those written
go). Mode overwrite empties the table first, in the same transaction. Cells of
another kind than their column are null. Columns that a file hasn't are null;
a file without the table has no rows.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .sqlite import FETCH, TABLES, _as, quoted

ROWS = 1 << 17

#: Files that SQLite reads from at once.
ATTACHED = 8


def local(path: str) -> str:
    """A path without its file scheme; other schemes are no place for SQLite."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite reads files, not {path}")
    return path


def connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def columns_of(con: sqlite3.Connection, table: str) -> set[str]:
    return {r[1].lower() for r in con.execute(f"PRAGMA table_info({quoted(table)})")}


@dataclass
class Range(InputPartition):
    low: int
    high: int


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows

    def partitions(self) -> list[Range]:
        con = connected(self.path)
        try:
            if not columns_of(con, self.table):
                return [Range(0, -1)]
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        finally:
            con.close()
        return [Range(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)] if low is not None else [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        con = connected(self.path)
        try:
            there = columns_of(con, self.table)
            if there:
                cells = ", ".join(quoted(f.name) if f.name.lower() in there else "NULL" for f in kinds)
                cursor = con.execute(f"SELECT {cells} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.low, partition.high))
                while some := cursor.fetchmany(FETCH):
                    yield pa.RecordBatch.from_arrays([pa.array([_as(x, f.type) for x in c], f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], kinds.names)
        finally:
            con.close()


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, table: str, schema: StructType, key: str | None, replace: str | None, overwrite: bool):
        self.path, self.table, self.columns, self.key, self.replace, self.overwrite = path, table, [f.name for f in schema], key, replace, overwrite
        kinds = {"string": "TEXT", "double": "REAL", "float": "REAL"}
        self.kinds = {f.name: kinds.get(f.dataType.simpleString(), "INTEGER") for f in schema}
        self.stage = f"{path}.{uuid.uuid4().hex}"
        os.mkdir(self.stage)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        file = f"{self.stage}/{context.partitionId():08d}.{context.attemptNumber()}"
        con, n = sqlite3.connect(file), 0
        try:
            with con:
                con.execute(f"CREATE TABLE t ({', '.join(f'{quoted(c)} {k}' for c, k in self.kinds.items())})")
                for batch in iterator:
                    rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(self.columns))})", rows)
                    n += batch.num_rows
        finally:
            con.close()
        return Written(file, n)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(m.file for m in messages if m is not None)
        into, names = quoted(self.table), ", ".join(map(quoted, self.columns))
        try:
            while len(files) > ATTACHED:
                files = [self._merged(files[k : k + ATTACHED]) for k in range(0, len(files), ATTACHED)]
            con = sqlite3.connect(self.path, isolation_level=None)
            try:
                for k, file in enumerate(files):
                    con.execute(f"ATTACH ? AS part{k}", (file,))
                con.execute("BEGIN IMMEDIATE")
                kinds = ", ".join(f"{quoted(c)} {k}{' PRIMARY KEY' if c == self.key else ''}" for c, k in self.kinds.items())
                con.execute(f"CREATE TABLE IF NOT EXISTS main.{into} ({kinds})")
                if self.overwrite:
                    con.execute(f"DELETE FROM main.{into}")
                elif self.replace:
                    for k in range(len(files)):
                        con.execute(f"DELETE FROM main.{into} WHERE {quoted(self.replace)} IN (SELECT {quoted(self.replace)} FROM part{k}.t)")
                for k in range(len(files)):
                    con.execute(f"INSERT OR REPLACE INTO main.{into} ({names}) SELECT {names} FROM part{k}.t ORDER BY rowid")
                con.execute("COMMIT")
            except sqlite3.Error:
                if con.in_transaction:
                    con.execute("ROLLBACK")
                raise
            finally:
                con.close()
        finally:
            self._clean()

    def _merged(self, files: list[str]) -> str:
        """The files' rows, in their order, in the first of them."""
        con = sqlite3.connect(files[0], isolation_level=None)
        try:
            for k, file in enumerate(files[1:]):
                con.execute(f"ATTACH ? AS part{k}", (file,))
            con.execute("BEGIN")
            for k in range(len(files) - 1):
                con.execute(f"INSERT INTO main.t SELECT * FROM part{k}.t ORDER BY rowid")
            con.execute("COMMIT")
        finally:
            con.close()
        return files[0]

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        gone = f"{self.stage}.gone"
        os.rename(self.stage, gone)  # from now on no task makes a file in it
        shutil.rmtree(gone, ignore_errors=True)


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> Reader:
        return Reader(local(self.options["path"]), self.options["table"], schema, int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        o = self.options
        return Writer(local(o["path"]), o["table"], schema, o.get("key"), o.get("replace"), overwrite)


def table(spark: SparkSession, path: str, name: str, schema: str | None = None, rows: int = ROWS) -> DataFrame:
    """A table of a file, a range of row numbers a task."""
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", name).option("rows", rows)
    return (reader.schema(schema) if schema else reader).load()


def put(rows: DataFrame, path: str, name: str, *, key: str | None = None, replace: str | None = None, overwrite: bool = False) -> None:
    """Rows into a table of a file, all or none; see the module for ``key`` and ``replace``."""
    rows.sparkSession.dataSource.register(SqliteTable)
    writer = rows.write.format("sqlite_table").option("path", path).option("table", name)
    for option, value in (("key", key), ("replace", replace)):
        writer = writer.option(option, value) if value else writer
    writer.mode("overwrite" if overwrite else "append").save()


def write_crate(spark: SparkSession, path: str, name: str, wanted: DataFrame) -> int:
    """The crate's tracks become those of ``wanted`` (location) that the file knows; returns the crate's id.

    A crate that isn't there is made. Where no track is known, the crate is left without tracks.
    """
    con = sqlite3.connect(local(path))
    try:
        with con:
            con.execute("INSERT INTO crates (name) SELECT ? WHERE NOT EXISTS (SELECT 1 FROM crates WHERE name = ?)", (name, name))
        crate = con.execute("SELECT id FROM crates WHERE name = ?", (name,)).fetchone()[0]
        known = table(spark, path, "track_locations").select(F.col("id").alias("track_id"), "location")
        ours = wanted.select("location").distinct().join(known, "location").select(F.lit(crate).cast("long").alias("crate_id"), "track_id")
        if ours.isEmpty():
            with con:
                con.execute("DELETE FROM crate_tracks WHERE crate_id = ?", (crate,))
        else:
            put(ours, path, "crate_tracks", replace="crate_id")
    finally:
        con.close()
    return crate


#: The rate that cue places count in, and the first slot that is not the user's own.
CUE_RATE, FIRST_SLOT = 44_100, 4


def cue_rows(cues: DataFrame, locations: DataFrame) -> DataFrame:
    """Hot cues as the file holds them, for tracks whose file is there.

    cues: location, slot (from 0), name, position_ms. Places are whole samples;
    the label is the name with blanks and capitals.
    """
    known = locations.where("fs_deleted = 0").select(F.col("id").alias("track_id"), "location")
    label = F.initcap(F.regexp_replace("name", "_", " "))
    return cues.join(known, "location").select("track_id", F.lit(1).alias("type"), (F.col("position_ms") / 1000.0 * CUE_RATE).cast("long").alias("position"), F.lit(0).alias("length"), (F.col("slot") + FIRST_SLOT).cast("int").alias("hotcue"), label.alias("label"))


def write_cues(spark: SparkSession, path: str, cues: DataFrame) -> None:
    """Puts hot cues into the file, beside those that it has; tracks that it doesn't know are left out."""
    put(cue_rows(cues, table(spark, path, "track_locations")), path, "cues")
