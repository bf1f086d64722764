"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import durable, hint_small


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of edges (u, v); the label is the component's least node.

    Each round hangs every node's larger neighbours, then its smaller ones, under its least neighbour, until nothing
    changes: a number of rounds that grows with the logarithm of the longest path. Least neighbours come from partial
    minima before the shuffle, and neighbours are never gathered in a list, so a node with any number of edges is no
    group that one task must hold. Each round's edges are a durable table. A loop (u = v) gives a component of one.
    """
    own = edges.select("u", "v").where("u is not null and v is not null")
    now = durable(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        # A table of its own on either side of the join lets adaptive execution split the rows of a hub.
        large = both.where("v >= u").join(hint_small(least, f"{name}-least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large, f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hint_small(low, f"{name}-low"), "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        now = durable(small.distinct(), f"{name}-small")
        state, before = _state(now), state
        if state == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).union(now.select("v", "v").distinct()).groupBy("node").agg(F.min("label").alias("label"))
