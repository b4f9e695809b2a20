"""The corpus pipeline: five stages of the training-data operators, each over all that the one before kept.

run(spark, sf_dir) applies STAGES to documents, every result written as Parquet in the shared folder
and read again. Stages but the last return the columns of documents; a document that the mix takes
twice comes twice. No stage can be put in SQL as it works, so ORACLE_SQL is None and tests compare
the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.decontamination import decontaminate
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.language_id import fold, identify, learn
from tessera.llm.mixing import resampled
from tessera.llm.token_output import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell; lang says what it found."""
    known = learn(docs.where(F.coalesce(fold(F.col("doc_id"), 5), F.lit(0)) != 0).select("text", "lang"))
    told = identify(docs.select(F.struct("*").alias("document"), "text"), known).where("not rejected")
    return told.select(F.col("document").withField("lang", F.col("lang_pred")).alias("document")).select("document.*").select(docs.columns)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies; of repeated rows of it, one."""
    gone = jaccard_join(docs, by_text=True).where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    left = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"))
    kept = left.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti")
    return kept.select("document.*").dropDuplicates(["doc_id", "text"])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return resampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what was written as token ids."""
    return token_output(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", jaccard_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
