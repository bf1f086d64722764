"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of 13 words of an item (all words of a shorter one). A document that contains a window contains each of
its shingles, so one shingle is a sufficient prefix, and the rarest in the corpus gives the fewest candidates. Rarity is
counted over all documents at once; each window is filed under its rarest shingle; documents give, for each place of such
a shingle, the words that a window around it could cover; and the join on the shingle keeps a candidate only if the window
begins and ends inside of the document (position, length) and equals its words there.

Documents are read twice, whatever the size of the benchmark, and their texts are not shuffled. Tasks know the benchmark
only as a bit table of bounded size, which lets through all of its shingles and some others; the joins decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bytesops import ALNUM, LOWER, Words, chunks, grams, words
from quire.llm.shared import durable, hint_small, text_key, without

WINDOW = 13
SHINGLE = 5
BLOCK = 200_000  # filed windows up to which they are broadcast (about 50 MB); more are joined by a shuffle
MOST_BITS = 28  # the bit table has at most 2**28 bits, 32 MB
PAGE = 12  # and is put together from pages of 2**12 bits
WINDOWS = "item_id string, window string, shingles array<struct<shingle: long, place: int>>"
_SHINGLES = pa.list_(pa.struct([("shingle", pa.int64()), ("place", pa.int32())]))
CANDIDATES = "doc_id long, tkey long, n_words long, found array<struct<shingle: long, place: long, lead: int, around: string>>"
_FOUND = pa.list_(pa.struct([("shingle", pa.int64()), ("place", pa.int64()), ("lead", pa.int32()), ("around", pa.string())]))


def _joined(folded: bytes, found: Words, a: int, b: int) -> bytes:
    return b" ".join(folded[found.start[i] : found.stop[i]] for i in range(a, b))


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = words(chunk, ALNUM, LOWER)
                folded = LOWER[chunk.data].tobytes()
                by_n = {n: grams(found, n) for n in set(np.minimum(found.counts, SHINGLE).tolist()) if n}
                out: dict[tuple, list] = {}
                for i in range(len(chunk)):
                    a, b = int(found.first[i]), int(found.first[i + 1])
                    for s in range(a, max(b - length, a) + 1) if b > a else ():
                        e = min(s + length, b)
                        h, at = by_n[min(b - a, SHINGLE)]
                        mine = h[np.searchsorted(at, s) : np.searchsorted(at, e - min(b - a, SHINGLE), "right")]
                        key = batch.column(0)[chunk.first + i].as_py(), _joined(folded, found, s, e).decode()
                        out[key] = [{"shingle": x, "place": k} for k, x in enumerate(mine.view(np.int64).tolist())]
                if out:
                    cols = [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(out.values(), _SHINGLES)], ["item_id", "window", "shingles"])

    return run


def windows(benchmark: DataFrame, length: int = WINDOW, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, items, shingles): every distinct window once, with the ids of the items that have it (a null id as '')."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text"))
    each = items.mapInArrow(_windows(length), WINDOWS)
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.first("shingles").alias("shingles"))


class BitTable:
    """A set of hashes as bits, one for the hashes of equal leading bits: has() is true for all members and few others."""

    def __init__(self, bits: int, pages: dict[int, bytes]):
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << (bits - 3), np.uint8)
        size = 1 << (PAGE - 3)
        for number, page in pages.items():
            self.bits[number * size : (number + 1) * size] = np.frombuffer(page, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def bit_table(shingles: DataFrame) -> BitTable:
    """Of the column shingle. At most 2**MOST_BITS bits reach the driver, 64 a shingle while there is room."""
    bits = min(MOST_BITS, max(PAGE, (64 * shingles.count()).bit_length()))
    at = F.shiftrightunsigned("shingle", 64 - bits)

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << PAGE, bool)
        marks[rows["at"].to_numpy() & ((1 << PAGE) - 1)] = True
        return pd.DataFrame({"page": [rows["page"].iloc[0]], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    set_bits = shingles.select(at.alias("at")).distinct().withColumn("page", F.shiftright("at", PAGE))
    rows = set_bits.groupBy("page").applyInPandas(page, "page long, bits binary").collect()
    return BitTable(bits, {r["page"]: r["bits"] for r in rows})


def _count(table: BitTable, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                found = words(chunk, ALNUM, LOWER)
                for n in lengths:
                    h = grams(found, n)[0]
                    values, sums = np.unique(h[table.has(h)], return_counts=True)
                    if len(values):
                        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(sums)], ["shingle", "n"])

    return run


def _candidates(table: BitTable, lengths: list[int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, out = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
            for chunk in chunks(batch.column(2)):
                found = words(chunk, ALNUM, LOWER)
                n_words[chunk.first : chunk.first + len(chunk)] = found.counts
                doc, folded = found.doc(), None
                for n in lengths:
                    h, at = grams(found, n)
                    on = table.has(h)
                    if folded is None and on.any():
                        folded = LOWER[chunk.data].tobytes()
                    more = length - n if n == SHINGLE else 0  # windows of fewer words are their one shingle
                    for place, shingle in zip(at[on].tolist(), h[on].view(np.int64).tolist(), strict=True):
                        d = int(doc[place])
                        first, end = int(found.first[d]), int(found.first[d + 1])
                        a, b = max(first, place - more), min(end, place + n + more)
                        around = _joined(folded, found, a, b).decode()
                        out[chunk.first + d].append({"shingle": shingle, "place": place - first, "lead": place - a, "around": around})
            cols = [batch.column(0), batch.column(1), pa.array(n_words), pa.array(out, _FOUND)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tkey", "n_words", "found"])

    return run


def _covered(hits: Column) -> Column:
    """Number of places in these spans, which are in order."""
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("upto"), zero.alias("n"))
    more = lambda s, h: F.greatest(h["stop"] - F.greatest(h["start"], s["upto"]), zero)
    step = lambda s, h: F.struct(F.greatest(s["upto"], h["stop"]).alias("upto"), (s["n"] + more(s, h)).alias("n"))
    return F.aggregate(hits, state, step, lambda s: s["n"])


def find_windows(
    docs: DataFrame, benchmark: DataFrame, *, length: int = WINDOW, block_size: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, tkey, n_words, n_hit, hits, items for every row of docs.

    Words are runs of ASCII letters and digits and other than ASCII characters, with A-Z in lower case. hits are the spans
    of words of the windows found, items the ids of the items with such windows as strings in order. Null texts have no
    words; an item without words has no window; rows that repeat an id are handled each, and with their text they have the
    same hits; other columns are ignored; an empty benchmark gives no hits. block_size is how many filed windows are
    broadcast; more are joined by a shuffle, with the same result.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = keyed.select("doc_id", text_key().alias("tkey"), "text")
    wanted = durable(windows(benchmark, length), "decontamination-windows")
    each = wanted.select("window", "items", F.explode("shingles").alias("s")).select("window", "items", "s.*")
    n_shingle = F.least(F.size(F.split("window", " ")), F.lit(SHINGLE))
    lengths = sorted(r["n"] for r in wanted.select(n_shingle.alias("n")).distinct().collect())  # five values at most
    counted = keyed.select("text").mapInArrow(_count(bit_table(each.select("shingle").distinct()), lengths), "shingle long, n long")
    counts = hint_small(counted.groupBy("shingle").agg(F.sum("n").alias("n")), "decontamination-counts")
    ranked = each.join(counts, "shingle", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0).cast("long")), "shingle", "place"))
    least = ranked.groupBy("window").agg(F.min("rank").alias("least"), F.first("items").alias("items"))
    filed = least.select(F.col("least.shingle").alias("shingle"), F.col("least.place").alias("offset"), "window", "items")
    filed = hint_small(filed, "decontamination-filed", limit=block_size)
    searched = _candidates(bit_table(filed.select("shingle").distinct()), lengths, length)
    slim = durable(keyed.mapInArrow(searched, CANDIDATES), "decontamination-candidates")
    candidates = slim.where(F.size("found") > 0).select("doc_id", "tkey", F.explode("found").alias("f")).select("doc_id", "tkey", "f.*")
    around, size = F.split("around", " "), F.size(F.split("window", " "))
    inside = (F.col("lead") >= F.col("offset")) & (F.col("lead") - F.col("offset") + size <= F.size(around))
    equal = F.array_join(F.slice(around, F.greatest(F.col("lead") - F.col("offset"), F.lit(0)) + 1, size), " ") == F.col("window")
    start = F.col("place") - F.col("offset")
    found = candidates.join(filed, "shingle").where(inside & equal)
    span = F.struct(start.alias("start"), (start + size).alias("stop"))
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(
        F.array_sort(F.collect_set(span)).alias("hits"),
        # Windows of one item list are one member, so a text that repeats an item gathers its list once.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = hint_small(spans, "decontamination-hits", F.size("hits") + F.size("items"))
    same = slim["doc_id"].eqNullSafe(spans["_id"]) & (slim["tkey"] == spans["_key"])
    no_items = F.expr("cast(array() as array<string>)")
    no_hits = F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")
    return slim.join(spans, same, "left").select(
        "doc_id",
        "tkey",
        "n_words",
        F.coalesce(_covered(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hits", no_hits).alias("hits"),
        F.coalesce("items", no_items).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs, handled as find_windows() says.

    A document is called contaminated with at least 5 % of its words hit.
    """
    return find_windows(docs, benchmark, **more).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with all their columns.

    A single window is enough to go, so that no item's passage of 13 words is left, however long the text around it.
    Nulls and texts without words stay; rows that repeat an id and its text stay or go together; an empty benchmark drops
    nothing; no rows give none.
    """
    return without(docs, find_windows(docs, benchmark).where("n_hit > 0"))


ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS w, least(len(ws), 13) AS n
        FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
pos AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, pos.n, item_id FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM pos) pos JOIN win ON pos.w = win.w AND pos.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
