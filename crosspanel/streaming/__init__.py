"""Bars from an event stream: an extension beyond the batch panel, with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A directory of parquet files as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """One bar per user and window; a window closes when the watermark, ``late`` behind the newest event, passes it.

    The state is one row per open (user, window). Later events than that are dropped, as Spark's watermarks do.
    """
    order = F.struct("ts", "event_id")
    bars = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("instrument")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.sum("value").alias("amount"),
    )
    return bars.select("instrument", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume", "amount")


def write_bars(bars: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append closed bars to parquet, exactly once by the checkpoint."""
    writer = bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
