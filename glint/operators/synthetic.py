"""Made-up event streams for trials."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .augment import random_events


def spiral(spark: SparkSession, n: int = 500, *, width: int = 128, height: int = 128) -> DataFrame:
    """n events outwards along two turns within one second, of alternating polarity."""
    i, t = F.col("id"), F.col("id") / F.lit(float(n))
    x, y = (F.round(F.lit(size / 2.0) + t * 40 * f(t * (4 * math.pi))).cast("int") for size, f in ((width, F.cos), (height, F.sin)))
    return spark.range(n).select(i.alias("seq"), t.alias("t"), x.alias("x"), y.alias("y"), F.when(i % 2 == 0, 1).otherwise(-1).alias("p"))


def moving_bar(spark: SparkSession, steps: int, *, width: int, height: int) -> DataFrame:
    """A bar one pixel wide that crosses the frame: positive where it comes, negative where it leaves."""
    i = F.col("id")
    per = 2 * height
    step, k = F.floor(i / per), i % per
    x = F.floor(step * (width - 1) / max(1, steps - 1)).cast("int")
    behind = F.greatest(x - 1, F.lit(0))
    return spark.range(steps * per).select(i.alias("seq"), (step / float(steps)).alias("t"), F.when(k < height, x).otherwise(behind).alias("x"), (k % height).cast("int").alias("y"), F.when(k < height, 1).otherwise(-1).alias("p"))


def uniform(spark: SparkSession, n: int = 100_000, *, width: int = 640, height: int = 480, seed: int = 0) -> DataFrame:
    return random_events(spark, n, width=width, height=height, t_min=0.0, t_max=1.0, seed=seed)
