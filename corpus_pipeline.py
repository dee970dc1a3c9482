"""The training-data pipeline: each stage works on all that the one before kept.

Null and empty texts leave with the language stage, repeated rows and near copies with the second,
where ties go to the smallest doc_id; texts of any length are read whole. Every stage but the last
returns the columns it was given, further columns included; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from raceflow.llm import decontaminate, langid, mixing, neardup, sharding
from raceflow.llm.rows import table
from raceflow.session import cut_lineage, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter or with an unsure guess go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of every group of near copies (0.8 alike on five-word shingles)."""
    return neardup.kept_documents(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at their mixing rate, each once at most, so that their tokens meet the target weights."""
    return mixing.drawn(docs, table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; documents that share lines are drawn together."""
    return sharding.shard_documents(docs, links=sharding.shared_lines(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture), ("shards", shards)]

ORACLE_SQL = None  # language scores, mixing rates and propagation rounds are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
