"""Training corpus pipeline: documents to shards in five stages.

Each stage takes all rows its predecessor kept and returns the columns of
``documents``; the last one adds its own. Between stages the rows are written
as Parquet and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgraph.llm import decontam, mixing, near_dup, quality, sharding
from evidgraph.llm.common import read, settle


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc_id, th) is in ``dropped``. A merge join
    at every size: the dropped rows grow with the input, so a broadcast would
    only postpone the shuffle."""
    gone = settle(dropped.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct(), "dropped")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    return docs.join(gone.hint("merge"), same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the isolation forest keep."""
    return quality.quality_filter(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id:
    five-word shingles, similarity of 0.8 or more."""
    return _without(docs, near_dup.near_duplicates(docs, width=5, percent=80).filter("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return _without(docs, decontam.contamination(docs, read(spark, sf_dir, "benchmark")).filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as weighted fair queueing takes it."""
    return mixing.mix(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix dealt to 40 shards by jump consistent hashing of doc_id."""
    return sharding.shard(docs, 40)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: The isolation forest has no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
