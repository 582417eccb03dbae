"""Play history kept up by a stream of plays (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def history(plays: DataFrame, key: str = "path", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, times_used, last_used) of a batch or a stream of plays."""
    plays = plays.withColumn(time, F.col(time).cast("timestamp"))
    if plays.isStreaming:
        plays = plays.withWatermark(time, late)
    return plays.groupBy(key).agg(F.count("*").alias("times_used"), F.date_format(F.max(time), "yyyy-MM-dd").alias("last_used"))


def windowed(plays: DataFrame, key: str = "path", time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Plays in tumbling windows; windows that the watermark has passed are final."""
    plays = plays.withColumn(time, F.col(time).cast("timestamp"))
    return plays.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("plays"))


def to_memory(rows: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return rows.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
