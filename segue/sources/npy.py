"""Vectors and their labels from caches of numpy files.

A cached file has its vector in ``<hash>.npy`` and its labels in
``<hash>_metadata.json``, or, from before, its tags alone in
``<hash>_tags.json``. Files are binary rows; a file's header says how its bytes
are to be read.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the format: how a file begins.
MAGIC = b"\x93NUMPY"

READ = "path string, shape array<long>, vector array<double>, error string"
LABELS = "array<array<string>>"


def parse(content: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """(shape, numbers in the order of rows) of a file of whole or broken numbers or truth values."""
    if content[:6] != MAGIC or len(content) < 10:
        raise ValueError("no numpy file")
    wide = 2 if content[6] == 1 else 4
    size = int.from_bytes(content[8 : 8 + wide], "little")
    head = content[8 + wide : 8 + wide + size]
    if len(head) < size:
        raise ValueError("the header is cut short")
    try:
        about = ast.literal_eval(head.decode("utf-8" if content[6] >= 3 else "latin-1").strip())
        kind, by_column, shape = np.dtype(about["descr"]), bool(about["fortran_order"]), tuple(int(n) for n in about["shape"])
    except (SyntaxError, KeyError, TypeError, UnicodeDecodeError) as problem:
        raise ValueError(f"a header that can't be read: {problem}") from None
    if kind.kind not in "fiub":
        raise ValueError(f"cells of kind {kind.str} are no numbers")
    n = int(np.prod(shape, dtype=np.int64))
    body = content[8 + wide + size :]
    if min(shape, default=0) < 0 or len(body) < n * kind.itemsize:
        raise ValueError("the numbers are cut short")
    x = np.frombuffer(body, kind, n).astype(np.float64).reshape(shape, order="F" if by_column else "C")
    return shape, x.ravel(order="C")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                shape, x = parse(content.as_py())
                rows.append((path, list(shape), x, None))
            except ValueError as problem:
                rows.append((path, None, None, str(problem)))
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "shape", "vector", "error"])


def vectors(files: DataFrame) -> DataFrame:
    """(path, shape, vector, error) of files (path, content); one that can't be read has nulls and the error."""
    return files.select("path", "content").mapInArrow(_read, READ)


def cache(spark: SparkSession, folder: str) -> DataFrame:
    """(file_hash, embedding, top_tags, moods, error): what a cache folder has for each file.

    Without a file of labels a vector is incomplete and is left out; the older
    kind of file has tags and no moods. A vector or labels that can't be read
    give a row with nulls and the error.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(folder).select(name.alias("name"), "path", "content")
    found = vectors(files.where("name LIKE '%.npy'")).withColumn("file_hash", F.regexp_replace(name, r"\.npy$", ""))
    texts = files.where(F.col("name").rlike(r"_(metadata|tags)\.json$")).select(
        F.regexp_replace("name", r"_(metadata|tags)\.json$", "").alias("file_hash"), F.col("name").endswith("_tags.json").cast("int").alias("older"), F.decode("content", "UTF-8").alias("text")
    )
    about = texts.groupBy("file_hash").agg(F.min_by(F.struct("older", "text"), "older").alias("about"))
    rows = found.join(about, "file_hash")
    new = F.from_json("about.text", f"top_tags {LABELS}, moods {LABELS}")
    pairs = lambda c: F.transform(F.coalesce(c, F.array().cast(LABELS)), lambda p: F.struct(p[0].alias("label"), p[1].try_cast("double").alias("prob")))
    old = F.col("about.older") == 1
    tags = F.when(old, pairs(F.from_json("about.text", LABELS))).otherwise(pairs(new["top_tags"]))
    moods = F.when(old, pairs(F.lit(None).cast(LABELS))).otherwise(pairs(new["moods"]))
    broken = F.when(old, F.from_json("about.text", LABELS).isNull()).otherwise(F.try_parse_json("about.text").isNull())
    error = F.coalesce("error", F.when(broken, F.lit("labels that can't be read")))
    rows = rows.select("file_hash", F.transform("vector", lambda v: v.cast("float")).alias("embedding"), tags.alias("top_tags"), moods.alias("moods"), error.alias("error"))
    return rows.select("file_hash", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("embedding", "top_tags", "moods")], "error")
