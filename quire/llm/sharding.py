"""Sharding along a Hilbert curve.

Documents are placed in a grid of quantised metadata (size, language, source), sorted by the curve's index of their cell
and cut into runs. Neighbours on the curve are neighbours in every dimension, so each run covers a small box and a reader
that filters on any of the dimensions can skip most files by their statistics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import durable

BITS = 5  # 32 steps a dimension
DIMS = 3


def hilbert_index(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of every row of an (n, dims) array of integers below 2**bits (Skilling's transform)."""
    x = coordinates.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the highest bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _cells(spark: SparkSession) -> DataFrame:
    """(_cell, curve): the curve's index of each of the 2**(BITS * DIMS) = 32,768 cells of the grid."""
    cells = np.arange(1 << (BITS * DIMS))
    axes = np.stack([(cells >> (BITS * (DIMS - 1 - d))) & ((1 << BITS) - 1) for d in range(DIMS)], axis=1)
    return spark.createDataFrame(pd.DataFrame({"_cell": cells.astype(np.int32), "curve": hilbert_index(axes)}), "_cell int, curve long")


def ranked(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """(rows with _rank, from 0 in this order; their number): rows are dealt by range and sorted, and written with their
    place in their partition, so that a partition's count is all that leaves it and no second shuffle is needed.
    """
    at = F.monotonically_increasing_id()  # the partition's number in the upper bits, the place in the lower 33
    dealt = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one a partition
    starts, before = [], 0
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    both = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return both.withColumn("_rank", place + F.col("_start")).drop("_part", "_start", "_at"), before


def _step(values: DataFrame, name: str) -> Column:
    """Order-preserving step of a string column: how many of at most 31 cut points, quantiles of its distinct values, it reaches.

    The distinct values are dealt by range, so that a column with very many of them never meets in one task.
    """
    each = values.select(F.col(name).alias("v")).where("v is not null").distinct()
    found, total = ranked(each, ["v"], "sharding-values")
    tiles = 1 << BITS
    firsts = sorted({-(-t * total // tiles) for t in range(1, tiles)} - {0, total})
    cuts = [r["v"] for r in found.where(F.col("_rank").isin(firsts)).collect()]  # fewer than 32
    return sum([F.when(F.col(name) >= cut, 1).otherwise(0) for cut in cuts], F.lit(0)).cast("int")


def placed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row: Column | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, size_step, lang_step, source_step, curve for every row; null text: size 1, sum 0.

    row: what else to carry along, as a column row.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    size, crc = (F.octet_length(raw) + 1).cast("long"), F.crc32(raw)
    own = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *([] if row is None else [row.alias("row")]),
    )
    slim = durable(own, "sharding-slim") if row is None else own
    size_step = F.least(F.floor(F.log2(F.col("size").cast("double")) * 1.5), F.lit((1 << BITS) - 1)).cast("int")
    steps = slim.select("*", size_step.alias("size_step"), _step(slim, "lang").alias("lang_step"), _step(slim, "source").alias("source_step"))
    cell = (F.col("size_step") * (1 << BITS) + F.col("lang_step")) * (1 << BITS) + F.col("source_step")
    # The whole grid is a table of fixed size, so rows need no Python and no shuffle to find their place on the curve.
    return steps.withColumn("_cell", cell).join(F.broadcast(_cells(docs.sparkSession)), "_cell").drop("_cell")


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """rows with shard and slot added; they have curve, doc_id, size and text_crc32, by which they are ranked."""
    found, total = ranked(rows, ["curve", "doc_id", "size", "text_crc32"], "sharding-runs")
    at = F.floor(F.col("_rank") * shards / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int")
    first = F.ceil(F.col("shard").cast("decimal(38,0)") * F.lit(total) / shards).cast("long")
    return found.withColumn("shard", at).withColumn("slot", F.col("_rank") - first)


def shard(docs: DataFrame, shards: int = 16, **columns: str) -> DataFrame:
    """One row for every row of docs, with its shard and its slot there, by equal numbers of rows along the curve.

    Rows are ranked by (curve, doc_id, size, text_crc32); shard s takes ranks ceil(s n / shards) up to the next, so that
    counts differ by one at most, and slots count from 0. Ranks come from a range partitioning and the partitions' counts:
    no partition has to hold a whole cell, since ids divide cells. Nulls rank first. Rows equal in all four are
    interchangeable. No rows give none. Columns beside the four named ones are ignored.
    """
    own = ["doc_id", "size", "text_crc32", "shard", "slot", "curve", "size_step", "lang_step", "source_step"]
    return _dealt(placed(docs, **columns), shards).select(*own)


def sharded(docs: DataFrame, shards: int = 16, **columns: str) -> DataFrame:
    """Every row of docs with all its columns, and its shard and slot as shard() deals them.

    A row travels whole, so rows that repeat an id, a text or everything come out as often as they went in, each with a
    slot of its own. shard and slot are the last two columns; columns of docs with these names are replaced. Nulls, empty
    texts and tables without rows are handled as in shard().
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = _dealt(placed(docs, row=F.struct("*"), **columns), shards)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], "shard", "slot")


def write_shards(docs: DataFrame, shards: int | DataFrame, path: str, **columns: str) -> None:
    """Writes the rows of sharded(docs) under path/shard=N, each file in the order of its column slot.

    shards is their number, or an assignment that shard() made for docs, whose number of shards is taken: rows fall into
    the same shards and slots again. As many rows are written as docs has, whatever repeats in it.
    """
    if isinstance(shards, DataFrame):
        shards = (shards.agg(F.max("shard").alias("s")).first()["s"] or 0) + 1
    rows = sharded(docs, shards, **columns)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
