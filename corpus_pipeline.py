"""A corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a table;
all but the last return the columns of `documents`. run() writes each stage's result as
Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.llm import nearcopies, packing, quality, repeats, secrets
from glint.llm.common import materialize
from glint.llm.queries import quality_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the rest go. Without labels all stay."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, and of the smallest text hash.

    Near-duplicates are texts whose sets of 5-word shingles have a Jaccard similarity of
    0.8 at least, exactly, and what such texts link. Rows without an id come last, null
    texts count as empty. Repeated rows are put together before the texts are dealt by id
    and text hash, and the join uses that dealing: texts are sent once, and at every size
    in the same way. Other columns may have any name; no rows give no rows.
    """
    key = (F.col("doc_id").isNull().alias("nameless"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    marked = materialize(nearcopies.near_copies(docs), "near")
    kept = marked.groupBy("root").agg(F.min(F.struct(*key, "mark")).alias("kept")).select(*(F.col("kept")[c].alias(f"kept_{c}") for c in ("nameless", "id", "mark")))
    kept = materialize(kept, "kept")
    # the row travels as one struct, so that none of its columns can clash with other names
    rows = docs.select(*key, nearcopies.text_mark().alias("mark"), F.struct("*").alias("row"))
    each = rows.groupBy("nameless", "id", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    # kept rows are distinct; a semi join would be moved below the aggregate, and repeated rows be sent
    same = [F.col(c) == F.col(f"kept_{c}") for c in ("nameless", "id", "mark")]
    return each.join(kept.hint("merge"), same).select("row.*")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start in an earlier one. A null text becomes empty."""
    return repeats.without_repeats(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced. A null text stays null, and empty ones empty."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: every piece of every document with its ids and place.

    Null and empty texts are one piece of one id; no documents give no rows.
    """
    return packing.packed_sequences(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeats_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`. A table that the next stage has read is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
