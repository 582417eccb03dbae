"""Analysis of a folder that goes on: new files as they come, each once, and files again on demand.

What is found lies in folders by batch below ``out``, as Parquet. A batch
writes its own folder anew, so one that is done again after a failure leaves no
row twice; the checkpoint says which files are done. Files whose content an
earlier batch has analysed take its row. A file that can't be analysed has a
row with its error, and does not hold up the others.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segue.sources import audio

FILES = "path string, modificationTime timestamp, length long, content binary"
RESULT = f"{audio.SCHEMA}, batch long, again string"


def results(spark: SparkSession, out: str) -> DataFrame:
    """All rows of all batches, also of those of files that were analysed again."""
    try:
        return spark.read.schema(RESULT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(out)
    except AnalysisException:
        return spark.createDataFrame([], RESULT)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each path: of forced ones before all others, then of the last batch."""
    order = Window.partitionBy("path").orderBy(F.desc_nulls_last("again"), F.desc("batch"))
    return results(spark, out).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _write(rows: DataFrame, folder: str, batch: int, again: str | None) -> None:
    rows.withColumn("batch", F.lit(batch).cast("long")).withColumn("again", F.lit(again).cast("string")).write.mode("overwrite").parquet(folder)


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Starts analysing the files below a folder; with ``once`` it ends when all that are there are done."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)

    def work(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = results(session, out).where((F.col("batch") != number) | F.col("again").isNotNull())
        _write(audio.analysed(audio.hashed(batch), known), f"{out}/batch={number}", number, None)

    writer = files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def again(spark: SparkSession, paths: list[str], out: str) -> None:
    """Analyses these files anew, whatever earlier batches have; their rows come before all others from now on."""
    last = results(spark, out).agg(F.max("again")).first()[0]
    number = f"{int(last.split('-')[0]) + 1 if last else 0:08d}-{uuid.uuid4().hex}"
    files = spark.read.format("binaryFile").load(paths)
    _write(audio.analysed(audio.hashed(files)), f"{out}/again={number}", -1, number)
