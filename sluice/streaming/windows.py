"""Windows over event time, for batches and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Count of each tumbling (or sliding) window; *late*: how long a stream waits for events."""
    if late:
        events = events.withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: tuple[str, ...], late: str | None = None) -> DataFrame:
    """Sessions per key: a session ends when *gap* passes without an event."""
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n")


def distinct_events(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """A stream without repeats of *keys* within the waiting time."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
