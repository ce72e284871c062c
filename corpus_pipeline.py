"""Corpus preparation: the documents table through five stages, each written and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps of ``docs``. All but the last return the columns of ``documents``; the last returns
doc_id, n_tokens, ids and n_chars. Stages handle nulls and repeated rows as the operators'
docstrings say: null texts are empty ones, null ids take no part in deduplication and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitcart.llm import bpe, common, oph, pairwise, raking, randomness
from orbitcart.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the model's threshold go."""
    labels = table(spark, sf_dir, "labels").filter(~pairwise.held_out(F.col("doc_id")))
    return pairwise.keep_good(docs, pairwise.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    kept = oph.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"))
    own = kept.filter("kept_id IS NOT NULL").dropDuplicates()
    once = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return once.join(own, once.doc_id == own.kept_id, "left_semi").unionByName(docs.filter("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    clean = randomness.mask_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that expected tokens meet the raked weights."""
    mixed = raking.mix(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).dropDuplicates()
    return docs.join(mixed, docs.doc_id.eqNullSafe(mixed.kept_id), "left_semi")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again."""
    decoded = bpe.round_trip(docs, tokenizer_path())
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("text").cast("long").alias("n_chars"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The stages fit a model and hash with functions that SQL lacks; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
