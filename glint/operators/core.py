"""Blocks, filters, merging, bounds and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COLUMNS, numbered


def to_block(df: DataFrame) -> DataFrame:
    """x, y, t, p as doubles."""
    return df.select(*(F.col(c).cast("double").alias(c) for c in "xytp"))


def to_tensor_block(df: DataFrame) -> DataFrame:
    """x, y, t, p as floats; large times lose digits."""
    return df.select(*(F.col(c).cast("float").alias(c) for c in "xytp"))


def filter_by_time(df: DataFrame, t_min: float, t_max: float) -> DataFrame:
    """Events with t_min <= t <= t_max."""
    return df.where(F.col("t").between(t_min, t_max))


def split_by_polarity(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of polarity 0 and above, and those below."""
    return df.where("p >= 0"), df.where("p < 0")


def sort_by_time(df: DataFrame) -> DataFrame:
    """The events numbered by time, and by position where times are equal."""
    return numbered(df.withColumn("_seq", F.col("seq")), "t", "_seq").select(*COLUMNS)


def merge(*streams: DataFrame) -> DataFrame:
    """All events of the streams by time; ties by stream, then position. Duplicates stay."""
    if not streams:
        raise ValueError("nothing to merge")
    parts = [s.select("t", "x", "y", "p", F.lit(i).alias("_stream"), F.col("seq").alias("_seq")) for i, s in enumerate(streams)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return numbered(whole, "t", "_stream", "_seq").select(*COLUMNS)


def bounding_box(df: DataFrame) -> DataFrame:
    """One row min_x, min_y, max_x, max_y; nulls if there are no events."""
    return df.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def resolution(df: DataFrame) -> DataFrame:
    """One row width, height: the greatest pixels and one; 0, 0 if there are no events."""
    return df.agg(F.coalesce(F.max("x") + 1, F.lit(0)).alias("width"), F.coalesce(F.max("y") + 1, F.lit(0)).alias("height"))
