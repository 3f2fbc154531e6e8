"""Structured Streaming: incremental manifest, windowed counts and sessions. An extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """File stream over a parquet folder (or a glob that names files)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark; a timestamp without zone is read as UTC first, for streams accept no other kind."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def incremental_manifest(df: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the watermark: insert-if-unseen as a streaming state that is bounded."""
    return with_event_time(df, event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, event_time: str, delay: str, window: str, group: list[str]) -> DataFrame:
    """Tumbling counts, emitted when the watermark has passed the window."""
    w = F.window(event_time, window)
    return with_event_time(df, event_time, delay).groupBy(w, *group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *group, "n")


def sessions(df: DataFrame, event_time: str, delay: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key that a pause of ``gap`` ends."""
    s = F.session_window(event_time, gap)
    return with_event_time(df, event_time, delay).groupBy(s, key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there, then stops; started again it goes on from the checkpoint."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
