"""Cleaning of documents for training, in five stages; each works on all that the one before kept.

1. toxicity: documents that the classifier, learned from ``labels``, rejects go.
2. near_duplicates: of documents that 5-word shingles link at a Jaccard similarity of 0.8, one stays.
3. decontaminate: documents of which a twentieth of the words is inside benchmark windows go.
4. secrets: secrets in the texts are masked; all documents stay.
5. bpe: texts become token ids, which are decoded again to vouch for them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.  A
stage's docs are a Parquet table, so it may read them several times.  Stages that hand texts to Python workers set the
session's Arrow batches to a few MB, as all five share the executors' memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.llm import bpe, jaccard, secret_scan, toxicity
from spreadlab.llm import decontaminate as benchmark_filter
from spreadlab.llm._session import small_batches, spool


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark_filter.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("bpe", encode)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written and read again.  The session's Arrow batches are then as before."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            docs = spool(stage(spark, docs, sf_dir), name)
        return docs
    finally:
        spark.conf.set(setting, before)
