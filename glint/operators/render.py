"""Pictures: drawn events, overlays, colour maps, histograms and flow arrows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clamp, in_frame, with_row
from .grids import temporal_histogram


def draw_events(df: DataFrame, *, width: int, height: int, mode: str = "polarity") -> DataFrame:
    """y, x, r, g, b of the hit pixels on black; the last event of a pixel is what shows.

    polarity: positive red, others blue. time: grey by time between least and greatest.
    polarity_time: red or blue, from 50 to 255 by time. Equal times are brightest.
    """
    last = df.where(in_frame(width, height)).groupBy("y", "x").agg(F.max_by("t", "seq").alias("t"), F.max_by("p", "seq").alias("p"))
    plus, zero = F.col("p") > 0, F.lit(0)
    if mode == "polarity":
        return last.select("y", "x", F.when(plus, 255).otherwise(0).alias("r"), zero.alias("g"), F.when(plus, 0).otherwise(255).alias("b"))
    if mode not in ("time", "polarity_time"):
        raise ValueError("mode is polarity, time or polarity_time")
    timed = with_row(last, df.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi")))
    share = F.try_divide(F.col("t") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    if mode == "time":
        grey = F.coalesce((share * 255).cast("int"), F.lit(255))
        return timed.select("y", "x", grey.alias("r"), grey.alias("g"), grey.alias("b"))
    level = F.coalesce((F.lit(50) + (share * 205).cast("int")), F.lit(255))
    return timed.select("y", "x", F.when(plus, level).otherwise(0).alias("r"), zero.alias("g"), F.when(plus, 0).otherwise(level).alias("b"))


def overlay_events(df: DataFrame, frame: DataFrame, *, width: int, height: int, alpha: float = 0.5) -> DataFrame:
    """y, x, r, g, b: the frame (y, x, r, g, b) with events blended over it one after another.

    Each event's blend is cut to whole numbers before the next, so order counts: a fold
    over a pixel's polarities in order. The events of a pixel meet in one row, 16 bytes
    each, so a pixel is to have well below a hundred million; a stream with hotter pixels
    is drawn window by window, each over the picture before.
    """
    seen = df.where(in_frame(width, height)).groupBy("y", "x").agg(F.sort_array(F.collect_list(F.struct("seq", "p"))).alias("hits"))
    joined = frame.join(seen, ["y", "x"], "left")

    def folded(channel: str, positive: int, other: int) -> Column:
        def step(held: Column, hit: Column) -> Column:
            colour = F.when(hit["p"] > 0, float(positive)).otherwise(float(other))
            return F.floor(held * (1 - alpha) + colour * alpha).cast("double")

        return F.aggregate(F.coalesce("hits", F.expr("cast(array() as array<struct<seq: bigint, p: int>>)")), F.col(channel).cast("double"), step).cast("int").alias(channel)

    return joined.select("y", "x", folded("r", 255, 0), folded("g", 0, 0), folded("b", 0, 255))


def _unit(value: Column) -> Column:
    lo, hi = F.col("_lo"), F.col("_hi")
    return F.when(hi <= lo, 0.0).when((lo >= 0) & (hi <= 1), value).otherwise(F.try_divide(value - lo, hi - lo))


def _byte(share: Column) -> Column:
    return (clamp(share, 0.0, 1.0) * 255).cast("int")


def colour_map(image: DataFrame, name: str = "gray") -> DataFrame:
    """y, x, r, g, b of a dense relation (y, x, value).

    Values within 0..1 that aren't all alike are taken as they are, others are put into
    0..1 by their least and greatest; if all are alike they are 0.
    """
    bounds = image.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    whole = with_row(image, bounds)
    v = _unit(F.col("value"))
    if name == "gray":
        return whole.select("y", "x", *(_byte(v).alias(c) for c in "rgb"))
    if name == "jet":
        return whole.select("y", "x", *(_byte(F.lit(1.5) - F.abs(v * 2 - k)).alias(c) for c, k in (("r", 1.0), ("g", 0.5), ("b", 0.0))))
    raise ValueError("the map is gray or jet")


def rgb_image(image: DataFrame) -> DataFrame:
    """y, x, r, g, b of a dense relation (channel, y, x, value) with channels 0, 1, 2.

    Values are put into 0..1 as in colour_map, by the least and greatest of all channels.
    A channel without a value at a pixel counts as 0.
    """
    wide = image.groupBy("y", "x").agg(*(F.max(F.when(F.col("channel") == i, F.col("value"))).alias(c) for i, c in enumerate("rgb")))
    whole = with_row(wide, image.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    return whole.select("y", "x", *(F.coalesce(_byte(_unit(F.col(c))), F.lit(0)).alias(c) for c in "rgb"))


def histogram_image(df: DataFrame, *, bins: int) -> DataFrame:
    """y, x, r, g, b of the non-white pixels of a picture of bins x 100: red bars up, blue bars down."""
    counts = temporal_histogram(df, bins=bins)
    top = counts.agg(F.greatest(F.max("positive"), F.max("negative"), F.lit(1)).alias("_top"))
    tall = with_row(counts, top).select("bin", *((F.col(c) / F.col("_top") * 50).cast("int").alias(c) for c in ("positive", "negative")))
    up = tall.where("positive > 0").select(F.explode(F.sequence(F.lit(50) - F.col("positive"), F.lit(49))).alias("y"), F.col("bin").alias("x"), F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    down = tall.where("negative > 1").select(F.explode(F.sequence(F.lit(51), F.lit(49) + F.col("negative"))).alias("y"), F.col("bin").alias("x"), F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(255).alias("b"))
    line = df.sparkSession.range(bins).select(F.lit(50).alias("y"), F.col("id").cast("int").alias("x"), F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return up.unionByName(down).unionByName(line)


def line_pixels(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """The pixels of a straight line, one for each step of its longer axis."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    if not n:
        return [(x0, y0)]
    steps = np.arange(n + 1)
    half = lambda a, b: a + np.sign(b - a) * ((2 * steps * abs(b - a) + n) // (2 * n))
    return list(zip(half(x0, x1).tolist(), half(y0, y1).tolist(), strict=True))


def flow_image(flow: DataFrame, *, width: int, height: int, grid: int) -> np.ndarray:
    """A (height, width, 3) picture on the driver: a blue arrow for each cell of (row, col, vx, vy).

    Arrows begin at the cell's centre and are up to grid / 2.5 long, in proportion to the
    greatest speed; their ends are kept within the picture and cut to whole pixels. The
    two strokes of a head are 5 long. Cells that hardly move, or whose centre is outside,
    have none. The picture is white if the cells don't fill the grid.
    """
    picture = np.full((height, width, 3), 255, np.uint8)
    cells = flow.select("row", "col", "vx", "vy").collect()  # a cell for each square of the picture
    if len(cells) != math.ceil(width / grid) * math.ceil(height / grid):
        return picture
    fastest = max((math.hypot(c.vx, c.vy) for c in cells), default=0.0)
    for row, col, vx, vy in cells:
        x0, y0 = col * grid + grid // 2, row * grid + grid // 2
        if max(abs(vx), abs(vy)) < 1e-5 or x0 >= width or y0 >= height:
            continue
        long = grid / 2.5 / fastest  # of a cell that moves by 1
        x1, y1 = (int(min(max(at + v * long, 0.0), most - 1.0)) for at, v, most in ((x0, vx, width), (y0, vy, height)))
        turn = math.atan2(y1 - y0, x1 - x0)
        heads = [(max(0, round(x1 + 5 * math.cos(turn + a))), max(0, round(y1 + 5 * math.sin(turn + a)))) for a in (math.radians(135), -math.radians(135))]
        for end, start in (((x1, y1), (x0, y0)), *((head, (x1, y1)) for head in heads)):
            for x, y in line_pixels(*start, *end):
                if 0 <= x < width and 0 <= y < height:
                    picture[y, x] = (0, 0, 255)
    return picture
