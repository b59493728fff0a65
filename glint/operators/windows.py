"""Time windows: two rules for edges, slices of equal length, and cumulative frames."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clamp, in_frame, with_row


def _positive(duration: float) -> None:
    if not duration > 0:
        raise ValueError("the duration must be above 0")


def tumbling(df: DataFrame, duration: float, origin: float | None = None) -> DataFrame:
    """df with w, the number of its window [origin + w * d, origin + (w + 1) * d).

    The origin is the first event's time by position. Windows without events have no rows.
    """
    _positive(duration)
    first = df.agg(F.min_by("t", "seq").alias("_t0")) if origin is None else df.sparkSession.range(1).select(F.lit(float(origin)).alias("_t0"))
    return with_row(df, first).withColumn("w", F.floor((F.col("t") - F.col("_t0")) / duration).cast("long")).drop("_t0")


def tumbling_exact(df: DataFrame, duration: float) -> DataFrame:
    """As tumbling, with edges made by adding the duration again and again.

    The edges are one number for each window, put together on the driver; every task finds
    its events' windows in them by halving. This is for as many windows as a driver holds.
    Events before the first one by position are in no window.
    """
    _positive(duration)
    row = df.agg(F.min_by("t", "seq"), F.max("t")).first()
    if row[0] is None:
        return df.withColumn("w", F.lit(0).cast("long"))
    edges = [row[0]]
    while edges[-1] <= row[1]:
        edges.append(edges[-1] + duration)
    cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_at", outputCol="_w", handleInvalid="skip")
    found = cut.transform(df.withColumn("_at", F.col("t") + F.lit(0.0)))
    return found.where("_w >= 1").withColumn("w", F.col("_w").cast("long") - 1).drop("_at", "_w")


def closed_windows(df: DataFrame, duration: float) -> DataFrame:
    """df with w: window 0 is [t0, t0 + d], window w is (t0 + w * d, t0 + (w + 1) * d]."""
    _positive(duration)
    first = df.agg(F.min_by("t", "seq").alias("_t0"))
    return with_row(df, first).withColumn("w", F.greatest(F.ceil((F.col("t") - F.col("_t0")) / duration) - 1, F.lit(0)).cast("long")).drop("_t0")


def window_spine(windowed: DataFrame) -> DataFrame:
    """w for every window from 0 to the last, empty ones too."""
    last = windowed.agg(F.max("w").alias("_w"))
    return last.where("_w is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w"))).alias("w"))


def window_counts(df: DataFrame, duration: float) -> DataFrame:
    """w and n_events for every closed window, empty ones too."""
    windowed = closed_windows(df, duration)
    counts = windowed.groupBy("w").agg(F.count("*").alias("n"))
    return window_spine(windowed).join(counts, "w", "left").select("w", F.coalesce("n", F.lit(0).cast("long")).alias("n_events"))


def window_grids(df: DataFrame, duration: float, *, width: int, height: int, kind: str = "voxel", bins: int = 5) -> DataFrame:
    """Images of each closed window: w, bin, y, x, value.

    kind is voxel (counts in `bins` bins between the window's own first and last event),
    count, or polarity. Empty windows have no rows here; window_spine lists them.
    """
    windowed = closed_windows(df, duration)
    if kind == "voxel":
        bounds = windowed.groupBy("w").agg(F.min_by("t", "seq").alias("t0"), F.max_by("t", "seq").alias("t1")).withColumnRenamed("w", "_w")
        from .grids import time_bin

        seen = windowed.where(in_frame(width, height)).join(bounds, F.col("w") == F.col("_w"))
        return seen.groupBy("w", time_bin(bins, F.col("t0"), F.col("t1")).alias("bin"), "y", "x").agg(F.count("*").alias("value"))
    values = {"count": F.count("*"), "polarity": F.sum(F.col("p").cast("long"))}
    if kind not in values:
        raise ValueError("kind is voxel, count or polarity")
    return windowed.where(in_frame(width, height)).groupBy("w", F.lit(0).alias("bin"), "y", "x").agg(values[kind].alias("value"))


def slices(df: DataFrame, n: int) -> DataFrame:
    """df with w from 0 to n - 1: n equal parts of [least t, greatest t); the greatest is in none."""
    whole = with_row(df, df.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi")))
    w = F.floor(F.try_divide(F.col("t") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / n))
    return whole.where("t < _hi").withColumn("w", clamp(w, 0, n - 1).cast("long")).drop("_lo", "_hi")


def frame_ends(t_min: float, t_max: float, n: int) -> list[float]:
    """The last times of n cumulative frames."""
    step = (t_max - t_min) / n
    return [t_min + step * (i + 1) for i in range(n)]


def first_frame(df: DataFrame, n: int) -> DataFrame:
    """df with frame, the first of n cumulative frames that an event is in.

    The n ends are numbers on the driver. An event after the last end is in no frame.
    """
    row = df.agg(F.min("t"), F.max("t")).first()
    if row[0] is None:
        return df.withColumn("frame", F.lit(0))
    ends = frame_ends(row[0], row[1], n)
    table = df.sparkSession.createDataFrame([(i, -float("inf") if i == 0 else ends[i - 1], e) for i, e in enumerate(ends)], "frame int, _lo double, _hi double")
    return df.join(F.broadcast(table), (F.col("t") > F.col("_lo")) & (F.col("t") <= F.col("_hi"))).drop("_lo", "_hi")
