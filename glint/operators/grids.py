"""Voxel grids, time surfaces, count images and frames, as relations of the hit pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clamp, fraction, in_frame, span, with_row

EPSILON = 2.220446049250313e-16


def time_bin(bins: int, t0: Column, t1: Column) -> Column:
    """The bin of t between the first and the last event's time, held within 0..bins-1."""
    share = fraction(F.col("t"), t0, t1, t1 - t0 + F.lit(EPSILON))
    return clamp(F.coalesce(share, F.lit(0.0)) * bins, 0.0, bins - 1.0).cast("int")


def voxel_grid(df: DataFrame, *, width: int, height: int, bins: int, method: str = "count") -> DataFrame:
    """bin, y, x, value: `count`, `binary`, `polarity` (its sum), or `polarity_separate`.

    The last counts positive events in bin b and all others in bin b + bins. Times run
    from the first to the last event by position; events outside the frame are left out.
    """
    whole = with_row(df, span(df)).where(in_frame(width, height))
    bin = time_bin(bins, F.col("t0"), F.col("t1"))
    values = {"count": F.count("*"), "binary": F.max(F.lit(1)).cast("long"), "polarity": F.sum(F.col("p").cast("long")), "polarity_separate": F.count("*")}
    if method not in values:
        raise ValueError(f"method is one of {', '.join(values)}")
    if method == "polarity_separate":
        bin = bin + F.when(F.col("p") > 0, 0).otherwise(bins)
    return whole.groupBy(bin.alias("bin"), "y", "x").agg(values[method].alias("value"))


def voxel_grid_signed(df: DataFrame, *, width: int, height: int, bins: int) -> DataFrame:
    """bin, y, x, value: the sum of polarities; a range of times under a microsecond counts as a second."""
    whole = with_row(df, span(df)).where(in_frame(width, height))
    dt = F.when(F.abs(F.col("t1") - F.col("t0")) < 1e-6, 1.0).otherwise(F.col("t1") - F.col("t0"))
    bin = clamp(F.floor((F.col("t") - F.col("t0")) / dt * bins).cast("double"), 0.0, bins - 1.0).cast("int")
    return whole.groupBy(bin.alias("bin"), "y", "x").agg(F.sum(F.col("p").cast("long")).alias("value"))


def _channel() -> Column:
    return F.when(F.col("p") > 0, 0).otherwise(1)


def time_surface(df: DataFrame, *, width: int, height: int, normalize: bool = False, combine: bool = False) -> DataFrame:
    """channel, y, x, value: the time of the last event of a pixel; channel 0 has positive events.

    normalize puts times between the first and the last event's into 0..1, null if the
    two are equal. combine takes the greater of both channels, at least 0.
    """
    last = df.where(in_frame(width, height)).groupBy(_channel().alias("channel"), "y", "x").agg(F.max_by("t", "seq").alias("value"))
    if normalize:
        last = with_row(last, span(df)).withColumn("value", _unit(fraction(F.col("value"), F.col("t0"), F.col("t1")))).drop("t0", "t1")
    if combine:
        return last.groupBy("y", "x").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("value")).select(F.lit(0).alias("channel"), "y", "x", "value")
    return last


def _unit(c: Column) -> Column:
    """c within 0..1; null stays null."""
    return F.when(c < 0, 0.0).when(c > 1, 1.0).otherwise(c)


def count_image(df: DataFrame, *, width: int, height: int, split: bool = True) -> DataFrame:
    """channel, y, x, value: events of a pixel, positive ones in channel 0 and the rest in 1."""
    return df.where(in_frame(width, height)).groupBy((_channel() if split else F.lit(0)).alias("channel"), "y", "x").agg(F.count("*").alias("value"))


def event_frame(df: DataFrame, *, width: int, height: int, method: str = "count", normalize: bool = False) -> DataFrame:
    """y, x, value: `count`, `polarity` (its sum) or `times` (the last event's, from 0 to 1).

    normalize divides by the greatest pixel, unhit ones counting 0, if that is above 0.
    """
    seen = df.where(in_frame(width, height)).groupBy("y", "x")
    if method == "count":
        image = seen.agg(F.count("*").cast("double").alias("value"))
    elif method == "polarity":
        image = seen.agg(F.sum(F.col("p").cast("long")).cast("double").alias("value"))
    elif method == "times":
        image = with_row(seen.agg(F.max_by("t", "seq").alias("last")), span(df))
        image = image.select("y", "x", F.when(F.col("t1") > F.col("t0"), _unit(fraction(F.col("last"), F.col("t0"), F.col("t1")))).otherwise(0.0).alias("value"))
    else:
        raise ValueError("method is count, polarity or times")
    if normalize:
        image = with_row(image, image.agg(F.greatest(F.max("value"), F.lit(0.0)).alias("_max"))).withColumn("value", F.when(F.col("_max") > 0, F.try_divide("value", "_max")).otherwise(F.col("value"))).drop("_max")
    return image


def decay_surface(df: DataFrame, *, width: int, height: int, decay: float = 0.05) -> DataFrame:
    """channel, y, x, value: exp(-(t_last - t) / decay) of the last event of a pixel and sign."""
    last = time_surface(df, width=width, height=height)
    return with_row(last, df.agg(F.max("t").alias("_t"))).withColumn("value", F.exp(-(F.col("_t") - F.col("value")) / decay)).drop("_t")


def temporal_histogram(df: DataFrame, *, bins: int) -> DataFrame:
    """bin, positive, negative: events by time; the last bin has the greatest time only."""
    whole = with_row(df, df.agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    bin = F.coalesce(fraction(F.col("t"), F.col("lo"), F.col("hi")) * (bins - 1), F.lit(0.0)).cast("int")
    return whole.groupBy(bin.alias("bin")).agg(F.count_if(F.col("p") > 0).alias("positive"), F.count_if(F.col("p") <= 0).alias("negative"))


def densify(image: DataFrame, *, width: int, height: int, channels: int = 1, channel: str = "channel", fill=0) -> DataFrame:
    """The relation with a row for each pixel of each channel; those not hit have `fill`."""
    spark = image.sparkSession
    i = F.col("id")
    every = spark.range(channels * height * width).select((i / (width * height)).cast("int").alias("_c"), (i / width % height).cast("int").alias("_y"), (i % width).cast("int").alias("_x"))
    on = (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x"))
    keyed = channel in image.columns
    if keyed:
        on = on & (F.col(channel) == F.col("_c"))
    joined = every.join(image, on, "left")
    return joined.select(*([F.col("_c").alias(channel)] if keyed else []), F.col("_y").alias("y"), F.col("_x").alias("x"), *(F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in image.columns if c not in (channel, "y", "x")))
