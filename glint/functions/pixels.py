"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_frame(width: int, height: int) -> Column:
    return F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)


def rounded(v: Column) -> Column:
    """v to the nearest whole number, halves away from zero: what F.round gives, which makes a decimal of each value."""
    near = F.rint(v)
    return F.when(F.abs(v - near) == 0.5, v + F.signum(v) * 0.5).otherwise(near)  # v - near is exact


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def span(df: DataFrame) -> DataFrame:
    """One row: times of the first and the last event by position, t0 and t1."""
    return df.agg(F.min_by("t", "seq").alias("t0"), F.max_by("t", "seq").alias("t1"))


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.join(F.broadcast(one_row))  # a single row


def fraction(value: Column, zero: Column, one: Column, width: Column | None = None) -> Column:
    """(value - zero) / (one - zero), null where the range is empty."""
    return F.try_divide(value - zero, width if width is not None else one - zero)
