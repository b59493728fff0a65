"""Readers of event files: text, packed binary, Parquet and HDF5, and of arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import EVENTS, narrow, numbered

#: One packed record: t, x, y, p and padding, 16 bytes, little-endian.
RECORD = np.dtype([("t", "<f8"), ("x", "<u2"), ("y", "<u2"), ("p", "i1"), ("pad", "V3")])
#: Names of the columns t, x, y, p in an HDF5 file, tried in this order (fixed values).
HDF5_NAMES = (("t", "x", "y", "p"), ("timestamps", "x_pos", "y_pos", "polarity"), ("ts", "xs", "ys", "ps"))

_FLOAT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
_COUNT = r"^\+?\d+$"
_WHOLE = r"^[+-]?\d+$"


def read_text(spark: SparkSession, path: str, *, strict: bool = False, delimiter: str | None = None, order: tuple[int, int, int, int] = (0, 1, 2, 3), header_lines: int = 0) -> DataFrame:
    """Events of text lines `t x y p`; empty lines and those that begin with # are skipped.

    Tokens beyond the fourth are ignored, lines with fewer are skipped. A token that
    doesn't parse drops its line, or with strict raises an error. order has the token
    number of t, x, y and p. seq follows file and line.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_path").alias("_file"))
    # Spark puts files into partitions by size, so the scan's own numbers follow path and place within a block only
    blocks = lines.groupBy(F.col("_file").alias("_f"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"), F.min("seq").alias("_least"))
    firsts = blocks.selectExpr("_f", "_b", "_least", "coalesce(sum(_n) over (order by _f, _b rows between unbounded preceding and 1 preceding), 0) as _first")  # a row for each block of a file
    lines = lines.join(F.broadcast(firsts), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    lines = lines.select("value", (F.col("_first") + F.col("seq") - F.col("_least")).alias("seq"), "_block", "_file")
    if header_lines:
        ranked = lines.where("_block = 0").groupBy("_file").agg(F.min("seq").alias("_low"))
        lines = lines.join(F.broadcast(ranked), "_file", "left").where(~(F.coalesce(F.col("seq") - F.col("_low"), F.lit(header_lines)) < header_lines) | (F.col("_block") > 0))
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    a = F.split(F.regexp_replace("value", r"^\s+", ""), delimiter and rf"\s*{delimiter}\s*" or r"\s+")
    t, x, y, p = (F.trim(F.get(a, F.lit(i))) for i in order)
    ok = t.rlike(_FLOAT) & x.rlike(_COUNT) & y.rlike(_COUNT) & p.rlike(_WHOLE)
    t, x, y, p = t.try_cast("double"), x.try_cast("int"), y.try_cast("int"), p.try_cast("int")
    ok = F.coalesce(ok & t.isNotNull() & x.between(0, 65_535) & y.between(0, 65_535) & p.between(-128, 127), F.lit(False))
    kept = kept.where(F.size(a) > max(*order, 3))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an event: "), F.col("value")))
        kept = kept.select("seq", *(F.when(ok, c).otherwise(bad).alias(n) for c, n in ((t, "t"), (x, "x"), (y, "y"), (p, "p"))))
        return kept
    return kept.where(ok).select("seq", t.alias("t"), x.alias("x"), y.alias("y"), p.alias("p"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Events of packed records; bytes after the last whole record are ignored.

    seq follows path and place, from the sizes of the files. A file is read by one task
    and held there whole, so it is to be below 2 GB; larger streams are several files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()  # no copy
                rows = np.frombuffer(raw, RECORD, raw.size // RECORD.itemsize)
                for at in range(0, len(rows), 1 << 16):
                    r = rows[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(r)), pa.array(np.arange(at, at + len(r))), pa.array(r["t"].copy()), *(pa.array(r[c].astype(np.int32)) for c in "xyp")], names=["path", "at", "t", "x", "y", "p"])

    rows = files.mapInArrow(unpack, "path string, at long, t double, x int, y int, p int")
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_of"), F.floor(F.col("length") / RECORD.itemsize).alias("_n"))
    firsts = sizes.selectExpr("_of", "coalesce(sum(_n) over (order by _of rows between unbounded preceding and 1 preceding), 0) as _first")  # a row for each file
    numbers = rows.join(F.broadcast(firsts), F.col("path") == F.col("_of"))
    return numbers.select((F.col("_first") + F.col("at")).cast("long").alias("seq"), "t", "x", "y", "p")


def read_parquet(spark: SparkSession, path: str, t_start: float | None = None, t_end: float | None = None) -> DataFrame:
    """Events of Parquet files with columns t, x, y, p and maybe seq; time bounds reach the scan."""
    df = spark.read.parquet(path)
    if t_start is not None:
        df = df.where(F.col("t") >= t_start)
    if t_end is not None:
        df = df.where(F.col("t") < t_end)
    return narrow(df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id()))


def read_hdf5(spark: SparkSession, path: str, dataset: str = "events") -> DataFrame:
    """Events of one HDF5 file on the driver: a compound dataset, a group of columns, or root columns."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py; Parquet needs nothing") from e
    with h5py.File(path, "r") as f:
        node = f.get(dataset)
        if isinstance(node, h5py.Dataset):
            return from_arrays(spark, *(node[c][:] for c in "xytp"))
        where = node if node is not None else f
        for t, x, y, p in HDF5_NAMES:
            if all(c in where for c in (t, x, y, p)):
                return from_arrays(spark, *(where[c][:] for c in (x, y, t, p)))
    raise ValueError(f"no events in {path}")


def read_events(spark: SparkSession, path: str, *, format: str | None = None, t_start: float | None = None, t_end: float | None = None, end_inclusive: bool = False, polarity: int | None = None, min_x: int | None = None, max_x: int | None = None, min_y: int | None = None, max_y: int | None = None, sort: bool = False, **options) -> DataFrame:
    """Events of a file or folder, by its extension; bounds of pixels are inclusive, t_end is not."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    kind = format or {"h5": "hdf5", "hdf5": "hdf5", "bin": "binary", "dat": "binary", "parquet": "parquet"}.get(ending, "text")
    reader = {"hdf5": read_hdf5, "binary": read_binary, "parquet": read_parquet, "text": read_text}[kind]
    df = reader(spark, path, **options)
    wanted = [F.col("t") >= t_start] if t_start is not None else []
    if t_end is not None:
        wanted.append(F.col("t") <= t_end if end_inclusive else F.col("t") < t_end)
    wanted += [F.col("p") == polarity] if polarity is not None else []
    for c, low, high in (("x", min_x, max_x), ("y", min_y, max_y)):
        wanted += [F.col(c) >= low] if low is not None else []
        wanted += [F.col(c) <= high] if high is not None else []
    for w in wanted:
        df = df.where(w)
    return numbered(df.withColumn("_seq", F.col("seq")), "t", "_seq").drop("_seq") if sort else df


def iterate(df: DataFrame) -> Iterator[tuple[float, int, int, int]]:
    """The events one by one as (t, x, y, p), a partition at a time on the driver. iterate_apart brings none there."""
    for r in df.orderBy("seq").toLocalIterator():
        yield r.t, r.x, r.y, r.p


def iterate_apart(df: DataFrame, each: Callable[[Iterator[tuple[float, int, int, int]]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that `each` makes of the events one by one as (t, x, y, p).

    It is called by every task, with the events of a range of seq in its order; the ranges
    follow each other and together have all events. Events and rows pass one after the other.
    """

    def run(batches):
        import pyarrow as pa

        rows = iter(each(event for batch in batches for event in zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        while some := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return df.orderBy("seq").select("t", "x", "y", "p").mapInArrow(run, schema)


def from_arrays(spark: SparkSession, xs, ys, ts, ps, on_overflow: str = "error") -> DataFrame:
    """Events of four arrays of one length."""
    import pyarrow as pa

    n = {len(a) for a in (xs, ys, ts, ps)}
    if len(n) > 1:
        raise ValueError("arrays of different lengths")
    if n == {0}:
        return spark.createDataFrame([], EVENTS)
    rows = pa.table({"seq": np.arange(len(xs)), "t": np.asarray(ts, float), "x": np.asarray(xs, np.int64), "y": np.asarray(ys, np.int64), "p": np.asarray(ps, np.int64)})
    return narrow(spark.createDataFrame(rows, "seq long, t double, x long, y long, p long"), on_overflow)


def from_array_blocks(blocks: DataFrame, on_overflow: str = "error") -> DataFrame:
    """Events of rows first, xs, ys, ts, ps: arrays of one length, and the seq of their first event."""
    zipped = F.arrays_zip("xs", "ys", "ts", "ps")
    same = F.coalesce((F.size("xs") == F.size("ys")) & (F.size("xs") == F.size("ts")) & (F.size("xs") == F.size("ps")), F.lit(False))
    rows = blocks.select("first", F.posexplode(F.when(same, zipped).otherwise(F.raise_error(F.lit("arrays of different lengths")))).alias("_at", "_event"))
    return narrow(rows.select((F.col("first") + F.col("_at")).alias("seq"), *(F.col(f"_event.{c}s").alias(c) for c in "txyp")), on_overflow)
