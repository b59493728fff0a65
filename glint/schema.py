"""The event schema, its checks, and the narrowing of wider numbers to it."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("p", T.IntegerType())])
COLUMNS = EVENTS.fieldNames()
PIXEL_MAX = 65_535


def narrow(df: DataFrame, on_overflow: str = "error") -> DataFrame:
    """Columns of any integer width as events.

    A pixel outside 0..65535 or a polarity outside -128..127 is an error, or wraps round
    as 16 or 8 bits do. A null, or a time that is NaN, is an error.
    """
    x, y, p = (F.col(c).cast("long") for c in "xyp")
    if on_overflow == "wrap":
        x, y, p = x.bitwiseAND(F.lit(PIXEL_MAX)), y.bitwiseAND(F.lit(PIXEL_MAX)), (p + 128).bitwiseAND(F.lit(255)) - 128
    elif on_overflow == "error":
        x, y = (_within(c, 0, PIXEL_MAX, n) for c, n in ((x, "x"), (y, "y")))
        p = _within(p, -128, 127, "p")
    else:
        raise ValueError("on_overflow is error or wrap")
    t = F.col("t").cast("double")
    t = F.when(t.isNull() | F.isnan(t), F.raise_error(F.lit("t is null or NaN"))).otherwise(t)
    return df.select(F.col("seq").cast("long").alias("seq"), t.alias("t"), *(c.cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (p, "p"))))


def _within(c: Column, low: int, high: int, name: str) -> Column:
    return F.when(c.between(low, high), c).otherwise(F.raise_error(F.concat(F.lit(f"{name} is out of range: "), F.coalesce(c.cast("string"), F.lit("null")))))


def signed(df: DataFrame) -> DataFrame:
    """Polarities 0 and 1 as -1 and 1; others stay."""
    return df.withColumn("p", F.when(F.col("p") == 0, -1).otherwise(F.col("p")))


def _in_buckets(df: DataFrame, key: str, bounds: list[float], out: str) -> DataFrame:
    """df with the number of its bucket between ascending bounds; null and NaN come last."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_lead", outputCol=out, handleInvalid="keep")
    return cut.transform(df.withColumn("_lead", F.col(key).cast("double") + F.lit(0.0))).drop("_lead")


def _quantiles(df: DataFrame, key: str, n: int) -> list[float]:
    """n - 1 approximate quantiles; a value that holds more rows than one bucket should comes several times."""
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    return [q + 0.0 for q in found if q is not None and math.isfinite(q)]


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """seq counted from 0 in the given order, without gathering the rows in one task.

    The first and the last key are numbers. Rows go to buckets by their values alone: the
    bounds are quantiles of the first key, taken once and put into the plan, so that it
    makes no difference how often or over how many partitions the plan is evaluated.
    Rows are numbered in their bucket, and a count for each bucket gives its first number.
    A value of the first key that fills buckets by itself is one bucket of its own, parted
    further by the other keys. Null and NaN come last; rows equal in all keys get
    numbers in any order.
    """
    n = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.drop("seq") if "seq" not in order else df
    found = _quantiles(rows, order[0], n)
    heavy = sorted({q for q in found if found.count(q) > 1}) if len(set(found)) < len(found) else []
    bounds = sorted({*found, *(math.nextafter(q, math.inf) for q in heavy)})
    parted = _in_buckets(rows, order[0], bounds, "_bucket0")
    parts = ["_bucket0"]
    if heavy and len(order) > 1:
        full = F.col(order[0]).cast("double").isin(heavy)
        for i, key in enumerate(order[1:-1], 1):  # a few values, such as the number of a stream
            parted = parted.withColumn(f"_bucket{i}", F.when(full, F.col(key).cast("double")).otherwise(0.0))
            parts.append(f"_bucket{i}")
        last = f"_bucket{len(order) - 1}"
        inner = sorted(set(_quantiles(parted.where(full), order[-1], n)))
        parted = _in_buckets(parted, order[-1], inner, last).withColumn(last, F.when(full, F.col(last)).otherwise(0.0))
        parts.append(last)
    counts = parted.groupBy(*parts).agg(F.count("*").alias("_n"))
    by = ", ".join(parts)
    firsts = counts.selectExpr(*(f"{c} as _of{c}" for c in parts), f"coalesce(sum(_n) over (order by {by} rows between unbounded preceding and 1 preceding), 0) as _first")  # a row for each bucket
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*(F.col(c).asc_nulls_last() for c in order)))
    same = [F.col(c) == F.col(f"_of{c}") for c in parts]
    joined = parted.withColumn("_place", place).join(F.broadcast(firsts), reduce(and_, same))
    return joined.select((F.col("_first") + F.col("_place") - 1).alias("seq"), *(c for c in df.columns if c != "seq"))


def appended_numbers(df: DataFrame, more: DataFrame) -> DataFrame:
    """df, then more, each in the order of its seq, numbered from 0."""
    base = df.agg(F.count("*").alias("_base"))
    again = numbered(more, "seq")
    return numbered(df, "seq").unionByName(again.join(F.broadcast(base)).withColumn("seq", F.col("seq") + F.col("_base")).drop("_base"))  # a single row
