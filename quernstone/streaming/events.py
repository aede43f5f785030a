"""Structured Streaming: windowed counts with watermarks, a change tail, a merge a batch.

Windows over event time are an extension: the operators they stand beside are keyed and untimed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def tumbling(events: DataFrame, at: str, size: str, *by: str, late: str = "1 day") -> DataFrame:
    """Counts and sums a window; works on streams and tables alike."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("w.start").alias("start_s"), *by, "n", "total")


def sliding(events: DataFrame, at: str, size: str, step: str, *by: str, late: str = "1 day") -> DataFrame:
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", size, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, *by: str, late: str = "1 day") -> DataFrame:
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("_at", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def run_available(stream: DataFrame, folder: str, merge: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """Handle what there is, then end; the checkpoint in ``folder`` makes a restart go on where it stopped."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if merge is not None:
        return writer.foreachBatch(merge).start()
    return writer.format("parquet").option("path", f"{folder}/data").start()


def tail(log: DataFrame, last: int) -> DataFrame:
    """Rows after an id, in order of time."""
    return log.where(F.col("id") > last).orderBy("created_at", "id")


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the files that appear below a folder: ``path, modificationTime, length, content``.

    With ``run_available`` this is one sweep of a watcher; its checkpoint remembers what was seen.
    """
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
