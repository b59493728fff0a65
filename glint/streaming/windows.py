"""Event-time twins of the window operators, for streaming DataFrames of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import in_frame
from ..schema import EVENTS


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of events as they come into a folder."""
    return spark.readStream.schema(EVENTS).parquet(path)


def with_timestamp(df: DataFrame) -> DataFrame:
    """df with ts, the time as a timestamp of microseconds."""
    return df.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))


def window_counts(df: DataFrame, duration: str, late: str = "1 hour") -> DataFrame:
    """w_start, n_events, positive and negative of each window; it closes when the watermark has passed."""
    timed = with_timestamp(df).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", duration)).agg(F.count("*").alias("n_events"), F.count_if(F.col("p") > 0).alias("positive"), F.count_if(F.col("p") <= 0).alias("negative")).select(F.col("window.start").alias("w_start"), "n_events", "positive", "negative")


def window_images(df: DataFrame, duration: str, *, width: int, height: int, late: str = "1 hour") -> DataFrame:
    """w_start, y, x, value: a count image for each window."""
    timed = with_timestamp(df.where(in_frame(width, height))).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", duration), "y", "x").agg(F.count("*").alias("value")).select(F.col("window.start").alias("w_start"), "y", "x", "value")


def latest_surface(df: DataFrame, *, width: int, height: int) -> DataFrame:
    """channel, y, x, value: the time of each pixel's last event so far. The state is a row for each pixel."""
    return df.where(in_frame(width, height)).groupBy(F.when(F.col("p") > 0, 0).otherwise(1).alias("channel"), "y", "x").agg(F.max_by("t", "seq").alias("value"))
