"""The corpus queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language, packing, pii, quality, repeats, search, secrets, sentencepiece, simhash
from .common import fold_of


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learns from the labels whose fold isn't 2 of 4."""
    return quality.fit(docs, labels.where(fold_of("doc_id", 4) != 2))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_model(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_repeats(_read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(_read(spark, sf_dir, "documents"), keep_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold_of("doc_id", 5) != 0))
    return language.identify(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives its text again."""
    docs = _read(spark, sf_dir, "documents")
    pieces = sentencepiece.load_pieces()
    encoded = sentencepiece.encode(docs, pieces)
    return sentencepiece.decode(encoded.withColumn("token_ids", F.col("ids")), pieces).select("doc_id", F.col("token_ids").alias("ids"), F.size("token_ids").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


#: The session's setting that has the key of the surrogates; without it a fixed one serves, which hides nothing from its readers.
SURROGATE_KEY, OPEN_KEY = "spark.glint.surrogateKey", "not-a-secret"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(_read(spark, sf_dir, "documents"), spark.conf.get(SURROGATE_KEY, OPEN_KEY)).select("doc_id", "n_entities", "text")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, its whole text as the query."""
    docs = _read(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_read(spark, sf_dir, "documents"))


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_suffix_array_dedup, op3_secret_scan, op4_best_fit_packing, op5_language_id, op6_sentencepiece, op7_pii_surrogates, op8_topk_search, op9_order_minhash, op10_simhash_neardup)}
ORACLE_SQL: dict[str, str] = {}
