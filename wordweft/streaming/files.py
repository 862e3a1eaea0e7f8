"""Structured Streaming over files: every stateless function runs unchanged, and counts run with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def apply(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Writes step(stream), a stateless step, as Parquet once per file, and stops when all files are done."""
    return step(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their value by hour and type; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
