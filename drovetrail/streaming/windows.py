"""Streams of movements or events: windowed activity with late data, and per-day totals.

An extension: the batch summaries as Structured Streaming queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """Parquet files of a folder as they arrive, so many in a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def activity(events: DataFrame, at: str, entity: str, days: int = 7, late: str = "1 day", start: str = "0 days") -> DataFrame:
    """window start, end, events and active entities (estimated) of n-day windows; rows later than ``late`` are left out.

    ``start`` shifts the windows, which else begin at 1970-01-01. Exact distinct counts aren't possible with bounded
    state; the estimate's standard error is 1 %.
    """
    win = F.window(at, f"{days} days", f"{days} days", start)
    counted = events.withWatermark(at, late).groupBy(win.alias("w")).agg(F.count("*").alias("events"), F.approx_count_distinct(entity, 0.01).alias("active"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "active")


def daily_totals(events: DataFrame, at: str, entity: str, value: str, late: str = "1 day") -> DataFrame:
    """entity, day, total: the input of trailing totals, complete once the watermark has passed the day."""
    win = F.window(at, "1 day")
    return events.withWatermark(at, late).groupBy(entity, win.alias("w")).agg(F.sum(value).alias("total")).select(entity, F.to_date("w.start").alias("day"), "total")


def once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all that has arrived, write it as Parquet and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
