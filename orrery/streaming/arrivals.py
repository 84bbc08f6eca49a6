"""Streaming ingest (an addition: bulk commands have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that arrive in a folder, each path once: the checkpoint remembers the files, so the stream needs no state."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def table_arrivals(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder whose names match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Take in what is there, then stop; the checkpoint makes it exactly once."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Event-time windows of a stream or a table; the watermark bounds the state of a stream."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size).alias("_w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), by, "n", "total")
