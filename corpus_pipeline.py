"""From raw documents to token files: five stages, each a Spark job over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns rows that are written to the shared folder and
read again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm import decontam, mixing, neardup, quality, token_files
from rastrum.llm.common import table, written
from rastrum.llm.queries import BYTE_BPE_IDS, END_ID, QUALITY_CUT, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), "quality")
    # a filter is not pushed below a generator, so the statistics are not copied into its conditions
    scores = quality.scored(docs, model).select("row", F.explode(F.array("score")).alias("score"))
    return scores.where(F.col("score") >= QUALITY_CUT).select("row.*")


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    return neardup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.without_passages(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the order of training, sources at their targets."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files, described from what was written."""
    return token_files.token_files(docs, tokenizer_path(), END_ID, BYTE_BPE_IDS).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality", keep_quality), ("near-dedup", one_per_class), ("decontamination", without_benchmark), ("mix", mixed), ("token-files", tokens)]

#: trees, signatures and tokenizers have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
