"""From raw documents to shards: quality rules, near duplicates, benchmark passages, mixing, sharding.

Each stage works on all rows that the one before kept, and its result is written as Parquet and
read again. All but the last return the columns of documents; the last adds shard and slot.
Near duplicates are documents with a similarity of 0.8 or more over five-word shingles. The mix
takes some documents twice, and these are separate rows from there on.

Any column may be null, and columns beyond those of documents are kept whatever their names. Very
long texts are read whole. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontam, mixing, ngram_join, quality, sharding
from tallyloom.llm.kit import bounded, marked, settled

SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds. A null or empty text fails; repeated rows stay or go together."""
    bounded(spark)
    return quality.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id (null last), of each group of linked ones; of rows that repeat both id and set, one. Texts without words all stay."""
    bounded(spark)
    return ngram_join.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. A null or empty text holds none; repeated rows stay or go together."""
    bounded(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them. A null source is a source; a text without words is never taken; repeated rows are separate documents, and a tie between equal rows shows nowhere."""
    bounded(spark)
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot. Repeated rows each get their own."""
    return sharding.shard(docs, SHARDS)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture), ("sharding", shards)]

#: SQL can express neither the knapsack of the mix nor the hash of the shuffle; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's table is dropped when the next one's is written; the last stays."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), marked()
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), mark)
    return docs
