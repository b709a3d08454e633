"""Incremental bars: windowed aggregation of an event stream under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; zone-less times are read as UTC."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(symbol, time, open, high, low, close, volume) of batch or stream alike."""
    at = F.struct("ts", "event_id")
    price = F.col("value")
    src = events.withWatermark("ts", late) if events.isStreaming else events
    out = src.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("volume"),
    )
    return out.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")
