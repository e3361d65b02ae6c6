"""The corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import exact_dedup, langid, packing, simhash, substring_dedup
from curaspark.llm.storage import materialize

#: Near copies: shingles of five words, Jaccard similarity of 0.8 or more; fingerprints within ten bits are candidates.
SHINGLE, SIMILARITY, DISTANCE = 5, 0.8, 10


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects; none where no row has a label to learn from."""
    model = langid.fit(docs)
    if model is None:
        return docs
    known = langid.identify(docs, model, keep_columns=True)
    return known.where("not rejected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest id."""
    return exact_dedup.exact_dedup(docs, keep_columns=True).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keeps the document with the smallest id."""
    groups = simhash.verified_groups(docs, shingle=SHINGLE, distance=DISTANCE, similarity=SIMILARITY)
    return docs.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that an earlier document has. A document that loses all its words goes."""
    cut = substring_dedup.remove_repeats(docs, keep_columns=True).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents out to padded batches."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("packing", pack)]

#: Language ID and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
