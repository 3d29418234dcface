"""The training-data pipeline: language ID, SimHash near-dedup, benchmark decontamination,
mixing sources to target weights, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns the columns of documents; the last returns doc_id, size, text_crc32, shard and slot.
``run`` writes each stage's rows as Parquet to the shared folder and reads them back.
Stages with Python workers bound the bytes of their Arrow batches for the session (``bounded_batches``), if it sets no bound itself.

Decisions: documents without a letter (``und``) go, and those in which no learned language stands out: their best score is below a level set from held-out
text, relative to the number of languages; of each near-duplicate group the document with the
smallest id stays; documents that hold a benchmark item go; a document is repeated as
often as the mix takes it (0 to 3 times); texts are dealt to 24 shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm import decontam, langid, mixing, sharding, simhash
from kgflow.llm.common import bounded_batches, read, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return langid.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return sharding.assign_shards(docs).select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Trained network, hashes and packing can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
