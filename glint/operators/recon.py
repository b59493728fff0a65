"""Frames of accumulated polarity, alone and as a cumulative series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import in_frame, with_row
from .grids import densify
from .windows import first_frame


def _normal(value, lo, hi, scale: float, offset: float):
    unit = F.try_divide(value - lo, hi - lo) * scale + offset
    held = F.when(unit < 0, 0.0).when(unit > 1, 1.0).otherwise(unit)
    return F.when(hi - lo < 1e-6, F.lit(float(offset))).otherwise(held)


def frame(df: DataFrame, *, width: int, height: int, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """y, x, value of every pixel: the sum of polarities, put into 0..1 over the whole frame."""
    sums = df.where(in_frame(width, height)).groupBy("y", "x").agg(F.sum(F.col("p").cast("double")).alias("value"))
    dense = densify(sums, width=width, height=height, fill=0.0)
    bounds = dense.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return with_row(dense, bounds).select("y", "x", _normal(F.col("value"), F.col("_lo"), F.col("_hi"), scale, offset).alias("value"))


def cumulative_frames(df: DataFrame, n: int, *, width: int, height: int, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """frame, y, x, value for n frames; frame i has all events up to its end.

    Sums for each frame and pixel are made once; a running sum over the frames of a pixel
    gives the frames, so events aren't read again for each. A pixel's group is n rows.
    """
    step = first_frame(df.where(F.lit(True)), n)
    deltas = step.where(in_frame(width, height)).groupBy("frame", "y", "x").agg(F.sum(F.col("p").cast("double")).alias("value"))
    dense = densify(deltas, width=width, height=height, channels=n, channel="frame", fill=0.0)
    running = dense.withColumn("value", F.sum("value").over(Window.partitionBy("y", "x").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = running.groupBy("frame").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).withColumnRenamed("frame", "_f")
    joined = running.join(F.broadcast(bounds), F.col("frame") == F.col("_f"))  # a row for each frame
    return joined.select("frame", "y", "x", _normal(F.col("value"), F.col("_lo"), F.col("_hi"), scale, offset).alias("value"))
