"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing to weights, sharding.

Every stage is one operator of quire.llm applied to all rows that the stage before it kept. A stage takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, jaccard, mixing, quality, sharding
from quire.llm.shared import durable, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Rows are judged each by id and text: repeated rows stay or go together.

    Null and empty texts fail the base rules and go; rows without id are judged like others; without labels only the base
    rules decide; no rows give none.
    """
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.where("not kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; of repeated rows one stays.

    Texts without words are no copies of each other and stay; rows without id come after all others; no rows give none.
    """
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no 13 words of a benchmark item occur. Null and empty texts stay; repeated rows stay or go together."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often (0 to 2 times) as the mix of sources takes them. A null source is a source; null texts have no words
    and are taken with the others of their hash; rows that repeat an id are taken together; no rows give none.
    """
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with all their columns, and their shard and slot along the curve. Repeated rows get a slot each; nulls rank first."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("hilbert sharding", sharding_stage),
]

#: The likelihood ratio's hashed byte runs, the curve's index and CRC-32 have no SQL form; tests/llm compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
