"""Counts and shares of an event stream by time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days", key: str = "event_type") -> DataFrame:
    """(start, key, n, total value) of tumbling windows; the same plan on a table and on a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("start"), key, "n", "value")
