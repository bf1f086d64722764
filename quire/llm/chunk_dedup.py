"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines with a word ends a chunk where its value is 0 modulo a divisor and is not
so a line later, so that a chunk has LEAST such lines. Whether a line ends a chunk depends on the lines just beside it
alone, so a passage that stands after other text in another document is cut at the same lines there. Chunks that occur again in the corpus are compared byte by byte with the
earliest of their digest and removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytesops import slices
from quire.llm.shared import durable, hint_small, text_key

DIVISOR = 3  # so many lines make a chunk on average
LINES = 2  # that the rolling hash covers
LEAST = 2  # lines with a word in a chunk, except where a whole text has fewer
MOST_LINES = 64  # in a chunk, if LEAST of them have a word: only runs of so many lines without a natural cut are cut by place
_MOD, _BASE = (1 << 61) - 1, 1_000_003
CHUNKS = "doc_id long, tkey long, chunk int, start int, stop int, n_lines int, digest binary"
_NAMES = ["doc_id", "tkey", "chunk", "start", "stop", "n_lines", "digest"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_OUT = pow(_BASE, LINES, _MOD)


def split_chunks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, stop, lines with a word) of consecutive chunks that make up the whole text, newlines included.

    What is left at the end with fewer than LEAST such lines belongs to the chunk before. A text with one such line is one
    chunk and counts as LEAST, so that its copies are found too.
    """
    held: tuple[int, int, int] | None = None
    lines = text.split("\n")
    last = len(lines) - 1
    rolling, window = 0, []
    low: list[bool | None] = []  # None for a line without a word
    for line in lines:
        if not line.strip():
            low.append(None)
            continue
        h = xxhash.xxh3_64_intdigest(line.encode())
        rolling = (rolling * _BASE + h) % _MOD
        window.append(h)
        if len(window) > LINES:
            rolling = (rolling - window.pop(0) * _OUT) % _MOD
        low.append(rolling % DIVISOR == 0)
    ends, later = [False] * len(lines), False
    for i in range(last, -1, -1):
        if low[i] is not None:
            ends[i], later = low[i] and not later, low[i]
    start, at, worded, n = 0, 0, 0, 0
    for i, line in enumerate(lines):
        at += len(line) + (i < last)
        worded += low[i] is not None
        n += 1
        if worded >= LEAST and (ends[i] or n >= MOST_LINES):
            if held:
                yield held
            held = start, at, worded
            start, worded, n = at, 0, 0
    if held:
        yield held if worded >= LEAST else (held[0], at, held[2] + worded)
    if not held or worded >= LEAST:
        yield start, at, max(worded, LEAST) if worded else 0


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[tuple] = []
        for doc_id, tkey, value in zip(*(batch.column(i) for i in range(3)), strict=True):
            text = value.as_py()
            for k, (a, b, lines) in enumerate(split_chunks(text) if text else ()):
                if lines >= LEAST:
                    rows.append((doc_id.as_py(), tkey.as_py(), k, a, b, lines, xxhash.xxh3_128_digest(text[a:b].rstrip("\n").encode())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def drop_repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: doc_id, text without repeated chunks, n_removed, removed.

    Candidates are all chunks with a word; split_chunks gives them two lines with a word at least, if the text has. Of those
    with equal bytes the earliest by doc_id (null last), then by place, stays; removed lists the others as
    start:stop:first_doc_id:first_start in code points of the original text, comma-joined by place. A chunk's last newline goes with it but does not count in the comparison, since
    a text may end there. Null texts stay null. Rows that repeat an id and its text are one document and get the same
    result. Other columns are ignored.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text_key().alias("tkey"), "text")
    found = durable(keyed.mapInArrow(_chunk, CHUNKS), "chunk-digests")
    again = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    spans = found.join(
        hint_small(again, "chunk-again"), "digest"
    ).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("chunk", "start", "stop", "digest")).alias("spans"))
    at = lambda t: keyed["doc_id"].eqNullSafe(t["_id"]) & (keyed["tkey"] == t["_key"])
    some = hint_small(spans.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), "spans"), "chunk-spans", F.size("spans"))
    each = keyed.join(some, at(some)).select("doc_id", "tkey", "text", F.explode("spans").alias("s"))
    body = F.rtrim(F.substring("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")), F.lit("\n"))
    bodies = durable(each.select("doc_id", "tkey", "s.*", F.encode(body, "utf-8").alias("body")).dropDuplicates(["doc_id", "tkey", "chunk"]), "chunk-bodies")
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "chunk", "tkey", "start")
    first = bodies.groupBy("digest").agg(F.min(F.struct(rank.alias("r"), F.col("body").alias("b"))).alias("f")).select("digest", "f.r", "f.b")
    is_first = F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("chunk") == F.col("r.chunk")) & (F.col("tkey") == F.col("r.tkey"))
    # The bytes decide, not the digest; put this way they are compared after the join and are no key to shuffle and sort by.
    gone = bodies.join(first, "digest").where(~is_first & F.array_contains(F.array("b"), F.col("body")))
    says = F.concat_ws(":", "start", "stop", F.coalesce(F.col("r.doc_id").cast("string"), F.lit("")), "r.start")
    cuts = gone.groupBy(
        F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")
    ).agg(F.array_sort(F.collect_list(F.struct("start", "stop", says.alias("says")))).alias("cuts"))
    cuts = hint_small(cuts, "chunk-cuts", F.size("cuts"))
    n = F.size("cuts")
    piece = lambda i: F.substring(
        F.col("text"),
        F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["stop"]) + 1,
        F.when(i == n, F.length("text")).otherwise(F.get("cuts", i)["start"]) - F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["stop"]),
    )
    left = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")
    return keyed.join(cuts, at(cuts), "left").select(
        "doc_id",
        F.when(F.col("cuts").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(F.size("cuts"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("cuts", lambda c: c["says"]), ","), F.lit("")).alias("removed"),
    )
