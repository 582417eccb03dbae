"""Storage, exchange and schema helpers of the training-data operators.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all
executors share; a local folder is set only where the session names none.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one where none is named and all runs on this machine."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not conf and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="segue-checkpoint-"))
    return conf or sc.getCheckpointDir()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Parquet tables of one operator run in the shared folder.

    ``keep`` writes a table and reads it back (lineage is cut); ``result``
    checkpoints the final frame and drops every table of the run. The tables
    of a run that fails are dropped once nothing refers to it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/segue-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.drop = weakref.finalize(self, _delete, spark, self.path)
        self.drop.atexit = False

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Lets Spark drop the shuffles of what is written by now, as it does when the driver's objects go; and what the driver itself no longer needs."""
        gc.collect()
        pa.default_memory_pool().release_unused()
        self.spark.sparkContext._jvm.System.gc()

    def result(self, df: DataFrame) -> DataFrame:
        out = df.checkpoint(eager=True)
        self.drop()
        return out


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores put before those that clash."""
    used = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), whatever else the frame holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def buckets_for(rows: int, per_bucket: int, least: int = 128) -> int:
    """So many hash buckets that each holds about ``per_bucket`` rows."""
    return max(least, -(-rows // per_bucket))
