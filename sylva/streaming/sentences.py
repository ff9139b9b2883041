"""Sentence streams: the row-local operators run unchanged on a stream; corpus counts need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylva.functions.text import escape_brackets, split_punctuation


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """text, file: lines of the files that come into a folder."""
    return spark.readStream.format("text").load(folder).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def tokenized(lines: DataFrame) -> DataFrame:
    """lines with their forms; empty lines are left out. Works on batches and streams."""
    return lines.where(F.trim("text") != "").withColumn("forms", F.transform(split_punctuation(F.col("text")), escape_brackets))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n: counts by tumbling window; rows later than `late` are dropped on a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, all that is there now."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
