"""Helpers that several operators use: table access, joins by counted size and small column idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column = "text") -> Column:
    """Tells rows of one id with different texts apart; null counts as its own value."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text, F.isnull(text))


def empty_to(df: DataFrame, **types: str) -> DataFrame:
    """Adds the missing ones of these columns as nulls."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in df.columns])



BROADCAST_KEYS = 1_000_000  # (id, text key) rows up to which they are broadcast: about 24 MB in an executor


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and text are not among keys (doc_id, tkey), with all their columns.

    The keys are written and counted first. Up to BROADCAST_KEYS of them go to the tasks and no document moves; more are
    joined by a shuffle.
    """
    gone = durable(keys.select(F.col("doc_id").alias("_gone_id"), F.col("tkey").alias("_gone_key")).distinct(), "without")
    n = gone.count()
    if not n:
        return docs
    same = docs[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (text_key(docs[text_col]) == gone["_gone_key"])
    return docs.join(F.broadcast(gone) if n <= BROADCAST_KEYS else gone, same, "left_anti")


SMALL = 200_000  # rows, or elements of arrays, of at most a few hundred bytes up to which a table is broadcast


def hint_small(df: DataFrame, name: str, elements: str | Column | None = None, limit: int = SMALL) -> DataFrame:
    """df as a durable table, marked for broadcast if it was counted to have at most limit rows; else it is shuffled.

    elements: what to count instead where rows hold arrays, the length of those.
    """
    df = durable(df, name)
    if elements is None:
        n = df.count()
    else:
        n = df.agg(F.sum(F.greatest(F.lit(1), elements)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= limit else df
