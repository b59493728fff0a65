"""Flips, rotations, crops, clips and warps: projections that fuse into one stage."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clamp, in_frame
from ..schema import PIXEL_MAX


def flip_x(df: DataFrame, *, width: int, check: bool = False) -> DataFrame:
    """x becomes width - 1 - x; with check an x outside the frame is an error."""
    return df.withColumn("x", F.lit(width - 1) - _checked("x", width, check))


def flip_y(df: DataFrame, *, height: int, check: bool = False) -> DataFrame:
    return df.withColumn("y", F.lit(height - 1) - _checked("y", height, check))


def _checked(name: str, size: int, check: bool) -> Column:
    c = F.col(name)
    return F.when(c.between(0, size - 1), c).otherwise(F.raise_error(F.lit(f"{name} is outside the frame"))) if check else c


def rotation(*, width: int, height: int, seed: int) -> tuple[float, tuple[float, float]]:
    """A random angle in radians and centre, for rotate."""
    rng = np.random.default_rng(seed)
    return float(rng.uniform(0, 2 * math.pi)), (float(rng.integers(width)), float(rng.integers(height)))


def rotate(df: DataFrame, *, radians: float, center: tuple[float, float], width: int | None = None, height: int | None = None, on_outside: str = "keep") -> DataFrame:
    """Turns pixels about a centre, rounding halves away from zero; t and p stay.

    on_outside: keep pixels outside the frame, drop them, or clamp them to its border.
    """
    cos, sin, (cx, cy) = math.cos(radians), math.sin(radians), center
    dx, dy = F.col("x") - F.lit(float(cx)), F.col("y") - F.lit(float(cy))
    x = F.round(dx * cos - dy * sin + float(cx)).cast("int")
    y = F.round(dx * sin + dy * cos + float(cy)).cast("int")
    if on_outside not in ("keep", "drop", "clamp"):
        raise ValueError("on_outside is keep, drop or clamp")
    if on_outside == "clamp":
        x, y = clamp(x, 0, width - 1), clamp(y, 0, height - 1)
    out = df.select(*(x.alias("x") if c == "x" else y.alias("y") if c == "y" else F.col(c) for c in df.columns))
    return out.where(in_frame(width, height)) if on_outside == "drop" else out


def rotate_degrees(df: DataFrame, *, degrees: float, center: tuple[float, float], width: int, height: int, clip: bool = False) -> DataFrame:
    """As rotate; outside pixels are dropped with clip, else put on the border."""
    return rotate(df, radians=math.radians(degrees), center=center, width=width, height=height, on_outside="drop" if clip else "clamp")


def _inside(bounds: tuple[int, ...]) -> Column:
    """Bounds are (min_y, max_y, min_x, max_x) or (max_y, max_x); the upper ones are outside."""
    if len(bounds) == 2:
        bounds = (0, bounds[0], 0, bounds[1])
    if len(bounds) != 4:
        raise ValueError("bounds are two or four numbers")
    y0, y1, x0, x1 = bounds
    return (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)


def clip(df: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """Events within the bounds."""
    return df.where(_inside(bounds))


def clip_to_zero(df: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """All events; those outside the bounds get x, y, t and p of zero."""
    inside = _inside(bounds)
    return df.select(*(F.when(inside, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in "xytp" else F.col(c) for c in df.columns))


def crop(df: DataFrame, *, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Events in [x0, x1) x [y0, y1), counted from its corner."""
    return df.where(_inside((y0, y1, x0, x1))).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def _moved(c: str, v: float | Column, t_ref: float | Column) -> Column:
    return F.round(F.col(c) + v * (F.col("t") - t_ref))


def warp_linear(df: DataFrame, *, vx: float, vy: float, t_ref: float) -> DataFrame:
    """Moves pixels by velocity * (t - t_ref), held within 0..65535; all events and times stay."""
    x, y = (clamp(_moved(c, v, t_ref), 0.0, float(PIXEL_MAX)).cast("int") for c, v in (("x", vx), ("y", vy)))
    return df.select(*(x.alias("x") if c == "x" else y.alias("y") if c == "y" else F.col(c) for c in df.columns))


def warp_constant_flow(df: DataFrame, *, vx: float, vy: float, t_ref: float) -> DataFrame:
    """As warp_linear, without events that leave 0..65535; all times become t_ref."""
    moved = df.withColumn("_x", _moved("x", vx, t_ref)).withColumn("_y", _moved("y", vy, t_ref)).where(f"_x between 0 and {PIXEL_MAX} and _y between 0 and {PIXEL_MAX}")
    new = {"x": F.col("_x").cast("int"), "y": F.col("_y").cast("int"), "t": F.lit(float(t_ref))}
    return moved.select(*((new[c] if c in new else F.col(c)).alias(c) for c in df.columns))
