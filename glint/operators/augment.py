"""Adding and removing events at random; a seed gives the same rows however they are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import below, gaussian, ticket, uniform
from ..functions.pixels import clamp
from ..schema import COLUMNS, appended_numbers, numbered
from .core import merge


def random_events(spark: SparkSession, n: int, *, width: int, height: int, t_min: float, t_max: float, seed: int) -> DataFrame:
    """n events, uniform over the frame and [t_min, t_max), of either polarity."""
    if n and (width < 1 or height < 1):
        raise ValueError("the frame is empty")
    i = F.col("id")
    return spark.range(n).select(i.alias("seq"), (F.lit(float(t_min)) + uniform(seed, "t", i) * float(t_max - t_min)).alias("t"), below(width, seed, "x", i).alias("x"), below(height, seed, "y", i).alias("y"), (below(2, seed, "p", i) * 2 - 1).alias("p"))


def _bounds(df: DataFrame) -> tuple[int, int, float, float]:
    """Width, height and times of the events, from one row that the driver reads."""
    r = df.agg(F.max("x"), F.max("y"), F.min("t"), F.max("t")).first()
    return (1, 1, 0.0, 1.0) if r[0] is None else (r[0] + 1, r[1] + 1, r[2], r[3])


def appended(df: DataFrame, more: DataFrame) -> DataFrame:
    """df, then more, numbered in that order."""
    return appended_numbers(df.select(*COLUMNS), more.select(*COLUMNS)).select(*COLUMNS)


#: Rows that the last step of a draw sorts, and bits of the hash that each step before it looks at.
LAST, BITS = 10_000, 12


def _drawn(df: DataFrame, k: int, hashed: Column, *keys: str) -> Column | None:
    """The condition that holds for exactly k rows, those of least (hash, keys); None if there are no more than k.

    Counts by the hash's leading bits find the k-th hash, a few bits at a time, until few
    enough rows are left to sort; no more than those are ever in one task. A null in the
    keys counts as least.
    """
    rows, shift, before = df.select(hashed.alias("_h"), *keys), 64, 0
    low, n = None, rows.count()
    if n <= k:
        return None
    while n > LAST and shift > 0:
        shift = max(0, shift - BITS)
        counts = rows.groupBy(F.shiftright("_h", shift).alias("cell")).count().orderBy("cell").collect()  # at most 2^BITS rows
        for r in counts:
            low, n = r.cell, r["count"]
            if before + n >= k:
                break
            before += n
        rows = rows.where(F.shiftright("_h", shift) == low)
    last = rows.orderBy("_h", *keys).limit(k - before).agg(F.max(F.struct("_h", *keys)).alias("last")).first().last if k else None
    if last is None:
        return F.lit(False)
    kinds = ["bigint", *(rows.schema[c].dataType for c in keys)]
    least = F.struct(*(F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(last, kinds, strict=True))))
    return F.struct(hashed.alias("k0"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keys, 1))) <= least


def add_random(df: DataFrame, n: int, *, seed: int, width: int | None = None, height: int | None = None, t_min: float | None = None, t_max: float | None = None, sort: bool = True, return_merged: bool = True) -> DataFrame:
    """df with n random events; what isn't given is taken from the events."""
    if None in (width, height, t_min, t_max):
        w, h, a, b = _bounds(df)
        width, height = width or w, height or h
        t_min, t_max = a if t_min is None else t_min, b if t_max is None else t_max
    new = random_events(df.sparkSession, n, width=width, height=height, t_min=t_min, t_max=t_max, seed=seed)
    return new if not return_merged else merge(df, new) if sort else appended(df, new)


def remove_random(df: DataFrame, k: int, *, seed: int, add_noise: int = 0) -> DataFrame:
    """df without exactly k events, in order; all of them if there are no more.

    With noise, that many random events over the whole range of df are added and all are
    sorted by time, unless every event was removed.
    """
    gone = _drawn(df, k, ticket(seed, "remove", F.col("seq")), "seq")
    kept = df.where(~gone) if gone is not None else df.limit(0)
    if not add_noise or not kept.limit(1).count():
        return kept
    w, h, a, b = _bounds(df)
    return merge(kept, random_events(df.sparkSession, add_noise, width=w, height=h, t_min=a, t_max=b, seed=seed + 1))


def add_correlated(df: DataFrame, k: int, *, seed: int, xy_std: float = 1.5, ts_std: float = 0.001, add_noise: int = 0, sort: bool = True, return_merged: bool = True) -> DataFrame:
    """df with k jittered copies of its events, each event used about equally often.

    Copies of the whole stream are numbered; of all of them k are drawn without
    replacement. Pixels are clamped to the frame, times aren't. No events stay none.
    """
    n = df.count()
    if not n:
        return df
    w, h, a, b = _bounds(df)
    copies = -(-k // n)
    row = (F.col("seq"), F.col("_copy"))
    many = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, copies)))))
    chosen = _drawn(many, k, ticket(seed, "copy", *row), "seq", "_copy")
    new = many.where(chosen) if chosen is not None else many
    new = new.select(F.xxhash64(*row).alias("seq"), (F.col("t") + gaussian(ts_std, seed, "t", *row)).alias("t"), clamp(F.round(F.col("x") + gaussian(xy_std, seed, "x", *row)), 0.0, float(w - 1)).cast("int").alias("x"), clamp(F.round(F.col("y") + gaussian(xy_std, seed, "y", *row)), 0.0, float(h - 1)).cast("int").alias("y"), "p")
    if add_noise:
        new = new.unionByName(random_events(df.sparkSession, add_noise, width=w, height=h, t_min=a, t_max=b, seed=seed + 1))
    new = numbered(new.withColumn("_seq", F.col("seq")), "t", "_seq").select(*COLUMNS) if sort or not return_merged else new
    return new if not return_merged else merge(df, new) if sort else appended(df, new)


def add_correlated_sampled(df: DataFrame, k: int, *, seed: int, xy_std: float, ts_std: float) -> DataFrame:
    """df, then k jittered events drawn with replacement."""
    n = df.count()
    if not n:
        return df
    w, h, *_ = _bounds(df)
    dense = numbered(df.withColumn("_seq", F.col("seq")), "_seq")
    i = F.col("id")
    drawn = df.sparkSession.range(k).select("id", F.floor(uniform(seed, "base", i) * n).alias("base"))
    new = drawn.join(dense, F.col("base") == F.col("seq")).select(i.alias("seq"), (F.col("t") + gaussian(ts_std, seed, "t", i)).alias("t"), clamp(F.round(F.col("x") + gaussian(xy_std, seed, "x", i)), 0.0, float(w - 1)).cast("int").alias("x"), clamp(F.round(F.col("y") + gaussian(xy_std, seed, "y", i)), 0.0, float(h - 1)).cast("int").alias("y"), "p")
    return appended(df, new)
