"""Helpers shared by the corpus operators: scratch tables and small column expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset and Spark runs in a single process (tests), a temporary folder
    of this process serves; on a cluster that would lose data, so it is an error.
    """
    global _own_dir
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="glint-")
    return f"file://{_own_dir}"


def write_table(df: DataFrame, name: str) -> str:
    """Writes df as Parquet into the shared folder and returns the path."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, cut off from its lineage: written to the shared folder and read again."""
    return read_table(df.sparkSession, write_table(df, name), df.schema)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that write_table made and no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_source(df: DataFrame) -> None:
    """Removes the files of a materialized table that no plan reads any more."""
    tops = {f.rpartition("/")[0] for f in df.inputFiles()}
    for top in tops:
        drop_table(df.sparkSession, top)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text; a null text is an empty one. All other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a thousand rows at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*(c.slice(at, 1000).to_pylist() for c in columns), strict=True)


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000, weight=None, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most `size` rows and about `most` units of weight(row)."""
    held: list[tuple] = []
    heavy = 0
    for row in rows:
        held.append(row)
        if weight:
            heavy += weight(row)
        if len(held) >= size or heavy >= most:
            yield _batch(held, schema)
            held, heavy = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
