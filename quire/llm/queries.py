"""Queries of this subpackage, as (spark, sf_dir) -> DataFrame, and their SQL for a check by another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chunk_dedup, decontamination, jaccard, langid, mixing, pii, quality, sharding, substring_dedup, warc
from quire.llm.shared import table
from quire.sources.tables import new_path


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeated_units(table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.drop_repeated_chunks(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tkey")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_copies", "n_text_links", "n_links")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~langid.held_out())
    return langid.predict(docs, langid.train(labelled)).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")  # among the intermediate tables, so that release() deletes it with them
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    own = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.parse_records(warc.read_records(spark, path)).select(*own)


_QUERIES = (
    op1_substring_dedup,
    op2_pii_spans,
    op3_mixing,
    op4_line_chunk_dedup,
    op5_decontamination,
    op6_quality_rules,
    op7_hilbert_sharding,
    op8_jaccard_join,
    op9_language_id,
    op10_warc_archive,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form (or none that runs on whole tables); tests/llm hold them against brute force."""
    return {
        "op1_substring_dedup": substring_dedup.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op5_decontamination": decontamination.ORACLE,
        "op8_jaccard_join": jaccard.ORACLE,
        "op10_warc_archive": warc.ORACLE,
    }
