"""A corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes and returns documents (the last returns packed pieces); each is written as Parquet in the
shared folder and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import decontaminate, near_dedup, packing, quality_cnn, secret_scan
from ratingloom.session import durable

#: A document goes if label 0 is likelier than this; low, as a good document must not be lost.
REJECT_BELOW = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the byte network doesn't reject; it is trained on the labels outside of its fold."""
    net = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = quality_cnn.score_texts(docs, net)
    return rated.filter(F.col(rated.columns[-1]) >= REJECT_BELOW).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8, the smallest id.

    Documents without an id stay; rows that repeat an id are one document and stay or go together.
    """
    judged = near_dedup.near_duplicates(docs, words=5, share=(80, 100))
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no test item was found."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars counted anew."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(
        F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: SQL can express neither the network nor the tokenizer; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
