"""Motion by contrast maximisation: warps, objectives and a grid search in one job."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import in_frame, rounded, with_row
from ..schema import PIXEL_MAX


class Warp(Protocol):
    """Pixels of an event under the parameters in columns vx and vy."""

    def __call__(self, t_ref: Column) -> tuple[Column, Column]: ...


class Objective(Protocol):
    """A score of a candidate from its pixels' counts; higher is better."""

    def __call__(self, n: Column, pixels: int) -> Column: ...


def constant_flow(t_ref: Column) -> tuple[Column, Column]:
    """Each pixel moved by velocity * (t - t_ref) and rounded."""
    return tuple(rounded(F.col(c) + F.col(v) * (F.col("t") - t_ref)) for c, v in (("x", "vx"), ("y", "vy")))


def variance(n: Column, pixels: int) -> Column:
    """The variance of the counts over all pixels, unhit ones too."""
    mean = F.sum(n) / F.lit(float(pixels))
    return F.sum(n * n) / F.lit(float(pixels)) - mean * mean


def active_pixels(n: Column, pixels: int) -> Column:
    """Fewer hit pixels are better."""
    return -F.count(n).cast("double")


def image_score(df: DataFrame, *, width: int, height: int, objective: Objective = variance) -> DataFrame:
    """One row, score: the objective of the events as they are; 0 if none is in the frame."""
    counts = df.where(in_frame(width, height)).groupBy("y", "x").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(objective(F.col("n"), width * height), F.lit(0.0)).alias("score"))


def grid(ranges: list[tuple[float, float, float]]) -> list[tuple[int, float, float]]:
    """(number, vx, vy) of all candidates: from each start while not above the end, vx outside."""
    if len(ranges) != 2:
        raise ValueError("a grid has two ranges")
    axes = []
    for start, end, step in ranges:
        if not step > 0:
            raise ValueError("a step must be above 0")
        axis, v = [], start
        while v <= end:
            axis.append(v)
            v += step
        axes.append(axis)
    return [(i, vx, vy) for i, (vx, vy) in enumerate((a, b) for a in axes[0] for b in axes[1])]


def grid_scores(df: DataFrame, ranges: list[tuple[float, float, float]], *, width: int, height: int, warp: Warp = constant_flow, objective: Objective = variance) -> DataFrame:
    """gid, vx, vy, score of every candidate; 0 if no event lands in the frame.

    Candidates are numbers that the caller lists, so they are broadcast to the events, which
    are dealt to all cores first, since each meets every candidate; counts are added up before
    the shuffle, one row for each candidate and pixel.
    """
    spark, pixels = df.sparkSession, width * height
    candidates = spark.createDataFrame(grid(ranges), "gid int, vx double, vy double")
    dealt = df.select("seq", "t", "x", "y").repartition(2 * spark.sparkContext.defaultParallelism, "seq")
    whole = with_row(dealt, df.agg(F.max_by("t", "seq").alias("_ref"))).select("t", "x", "y", "_ref")
    moved = whole.join(F.broadcast(candidates))
    x, y = warp(F.col("_ref"))
    seen = moved.select("gid", x.alias("x"), y.alias("y")).where(in_frame(min(width, PIXEL_MAX + 1), min(height, PIXEL_MAX + 1)))
    cell = F.col("gid").cast("long") * pixels + F.col("y").cast("long") * width + F.col("x").cast("long")  # one number, so that counting is cheap
    counts = seen.groupBy(cell.alias("_cell")).agg(F.count("*").alias("n")).select(F.expr(f"cast(_cell div {pixels} as int)").alias("gid"), "n")
    scores = counts.groupBy("gid").agg(objective(F.col("n"), width * height).alias("score"))
    return candidates.join(scores, "gid", "left").select("gid", "vx", "vy", F.coalesce("score", F.lit(0.0)).alias("score"))


def estimate_flow(df: DataFrame, ranges: list[tuple[float, float, float]], *, width: int, height: int, warp: Warp = constant_flow, objective: Objective = variance) -> DataFrame:
    """One row vx, vy, score: the best candidate, the first of equal ones."""
    return grid_scores(df, ranges, width=width, height=height, warp=warp, objective=objective).orderBy(F.desc("score"), "gid").limit(1).select("vx", "vy", "score")


def refine_flow(df: DataFrame, ranges: list[tuple[float, float, float]], *, width: int, height: int, rounds: int = 3) -> DataFrame:
    """estimate_flow, again around the best candidate with steps a fifth as long."""
    best = estimate_flow(df, ranges, width=width, height=height)
    for _ in range(rounds - 1):
        row = best.first()
        ranges = [(v - step, v + step, step / 5) for v, (_, _, step) in zip((row.vx, row.vy), ranges, strict=True)]
        best = estimate_flow(df, ranges, width=width, height=height)
    return best
