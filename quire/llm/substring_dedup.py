"""Substring dedup by hashing lines and paragraphs: of equal units anywhere in the corpus the earliest is kept, the rest goes.

A unit has ten words at least, since shorter lines (a greeting, a heading, a word) are often equal without being copies. It
is a line of so many words, or a paragraph of consecutive shorter lines that have so many together, or a whole text that has
fewer. What remains, a few shorter lines between such units, goes if it is repeated too and the units beside it went, so
that exact copies go whole. A passage that was put behind other text on its line is no line there, so of lines that hold more than one
sentence the sentences of ten words are units as well, nested in the line's. All have their digests in one table: a sentence
is also found where it stands as a line of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bytesops import slices
from quire.llm.shared import durable, hint_small, text_key

LEAST = 10  # words in a unit
SENTENCE = re.compile("[.!?…]*[^.!?…]+[.!?…]*|[.!?…]+")
UNITS = "doc_id long, tkey long, start int, stop int, whole boolean, digest binary"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
_NAMES = ["doc_id", "tkey", "start", "stop", "whole", "digest"]
RESULT = "doc_id long, text string, n_removed long, removed string"


class Block(NamedTuple):
    """A long line, or consecutive shorter ones; blocks hold all words of a text."""

    start: int
    stop: int
    words: bytes
    unit: bool
    line: bool


def normalised(text: str) -> bytes:
    """Lower-cased words with one space between them; ASCII whitespace parts words."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split())


def blocks(text: str, least: int = LEAST) -> list[Block]:
    found, at = [], 0
    for line in text.split("\n"):
        if words := normalised(line):
            found.append((at, at + len(line), words, words.count(b" ") + 1))
        at += len(line) + 1
    sole = sum(f[3] for f in found) < least
    out: list[Block] = []
    short: list[tuple[int, int, bytes, int]] = []

    def close() -> None:
        if short:
            out.append(Block(short[0][0], short[-1][1], b" ".join(f[2] for f in short), sole or sum(f[3] for f in short) >= least, False))
            short.clear()

    for f in found:
        if f[3] < least:
            short.append(f)
        else:
            close()
            out.append(Block(*f[:3], True, True))
    close()
    return out


def units(text: str, least: int = LEAST) -> Iterator[tuple[int, int, bool, bytes]]:
    """(start, stop, whether a block, words) of what is hashed of a text, each line before the sentences in it."""
    for block in blocks(text, least):
        yield block.start, block.stop, True, block.words
        if block.line and block.words.count(b" ") >= least:
            line = text[block.start : block.stop]
            parts = [(m.start(), m.end(), normalised(m.group())) for m in SENTENCE.finditer(line)]
            if sum(1 for p in parts if p[2]) > 1:
                for start, stop, own in parts:
                    if own.count(b" ") >= least - 1:
                        yield block.start + start, block.start + stop, False, own


def _hash(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, tkey, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for start, stop, whole, words in units(text or "", least):
                    rows.append((doc_id, tkey, start, stop, whole, blake2b(words, digest_size=16).digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return run


def rank(*more: Column | str) -> Column:
    """Rank of an occurrence: by id (null last), then by place."""
    return F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), *[F.col(c) if isinstance(c, str) else c for c in more])


def repeats(hashed: DataFrame) -> DataFrame:
    """The units that an earlier equal unit makes redundant, each with the place of that earliest one.

    Digests are counted with partial sums before the shuffle, so that a unit in a third of all documents sends one row a
    task. What occurs again is written first: if that is little it goes to all tasks, else both sides of the join come
    straight from a shuffle, which adaptive execution splits where it is skewed.
    """
    first = hashed.groupBy("digest").agg(F.min(rank("start", "tkey")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("tkey") == F.col("first.tkey"))
    return hashed.join(hint_small(first, "substring-first"), "digest").where(~same)


def remove(text: str, gone: list[tuple[int, int, bool, int | None, int]], least: int = LEAST) -> tuple[str, list[str]]:
    """(text that is left, what was removed) for a text and its units that occur earlier: start, stop, whether a block, where."""
    own = blocks(text, least)
    again = {g[0]: g for g in gone if g[2]}
    taken = [b.unit and b.start in again for b in own]
    beside = lambda i: all(taken[j] for j in (i - 1, i + 1) if 0 <= j < len(own))
    spans = [again[b.start] for i, b in enumerate(own) if b.start in again and (b.unit or beside(i))]
    nested = sorted((g for g in gone if not g[2]), key=lambda g: g[0])
    out, removed, at, k, s = [], [], 0, 0, 0
    for line in text.split("\n"):
        end, first = at + len(line), k
        while k < len(nested) and nested[k][0] < end:
            k += 1
        while s < len(spans) and spans[s][1] < at:
            s += 1
        if s < len(spans) and spans[s][0] <= at and end <= spans[s][1]:
            if spans[s][0] == at:
                removed.append(spans[s])
        elif k == first:
            out.append(line)
        else:
            places = [at, *[x for g in nested[first:k] for x in g[:2]], end]
            rest = "".join(text[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
            if normalised(rest):
                out.append(rest)
            removed += nested[first:k]
        at = end + 1
    return "\n".join(out), [f"{a}:{b}:{'' if doc is None else doc}:{place}" for a, b, _, doc, place in removed]


def _rebuild(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                says: list[str] = []
                if gone:
                    text, says = remove(text, [(g["start"], g["stop"], g["whole"], g["first_doc"], g["first_start"]) for g in gone], least)
                out.append((doc_id, text, len(says), ",".join(says)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_removed", "removed"])

    return run


def drop_repeated_units(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: doc_id, text without repeated units, n_removed, removed.

    Units are equal if their lower-cased words are. The earliest by doc_id, then by place, stays; all others go. removed
    lists them as start:stop:first_doc_id:first_start in code points of the original text, comma-joined by place, with the
    shorter lines that went beside them; sentences of a removed line are not listed. Nothing goes that does not stand
    earlier. Removed lines go with their newlines, and so does a line whose sentences all went. least: words in a unit. Lines
    without a word stay, but inside of a removed paragraph. Exact copies go whole. Rows without id rank last. Null text
    stays null. Rows that repeat an id and its text are one document: a unit is not removed in favour of its like there, and
    each row gets the same result. Other columns are ignored. No rows give none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Where ids do not repeat, they tell documents apart; a text key in each row of units is then only weight in the shuffles.
    n = own.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.isnull("doc_id")).alias("none")).first()
    unique = n["ids"] + min(n["none"], 1) == n["rows"]
    keyed = own.select("doc_id", (F.lit(0).cast("long") if unique else text_key()).alias("tkey"), "text")
    hashed = durable(keyed.mapInArrow(_hash(least), UNITS), "substring-units")
    item = F.struct("start", "stop", "whole", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    gone = repeats(hashed).groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.collect_set(item).alias("gone"))
    gone = hint_small(gone, "substring-gone", F.size("gone"))
    both = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_id"]) & (keyed["tkey"] == gone["_key"]), "left")
    return both.select("doc_id", "text", "gone").mapInArrow(_rebuild(least), RESULT)


ORACLE = """
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
             regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS ws FROM l0),
w AS (SELECT *, len(ws) >= 10 AS long, sum(len(ws)) OVER (PARTITION BY doc_id) < 10 AS sole,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, len(ws) >= 10 ORDER BY i) AS run FROM l WHERE len(ws) > 0),
b AS (SELECT doc_id, start, start + length(line) AS stop, array_to_string(ws, ' ') AS w, true AS unit, i FROM w WHERE long
      UNION ALL SELECT doc_id, min(start), max(start + length(line)), string_agg(array_to_string(ws, ' '), ' ' ORDER BY i), any_value(sole) OR sum(len(ws)) >= 10, NULL
                FROM w WHERE NOT long GROUP BY doc_id, run),
p0 AS (SELECT doc_id, i, start AS line_start, unnest(ps) AS piece, generate_subscripts(ps, 1) AS j
       FROM (SELECT *, regexp_extract_all(line, '[.!?…]*[^.!?…]+[.!?…]*|[.!?…]+') AS ps FROM w WHERE long)),
p AS (SELECT *, (line_start + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
             regexp_extract_all(lower(piece), '[^\\x20\\x09-\\x0D]+') AS ws FROM p0),
s AS (SELECT *, count(*) FILTER (len(ws) > 0) OVER (PARTITION BY doc_id, i) AS worded FROM p),
u AS (SELECT doc_id, i, 0 AS j, start, stop, w FROM b
      UNION ALL SELECT doc_id, i, j, start, start + length(piece), array_to_string(ws, ' ') FROM s WHERE worded > 1 AND len(ws) >= 10),
r AS (SELECT *, row_number() OVER o AS n, first_value(doc_id) OVER o AS first_doc, first_value(start) OVER o AS first_start
      FROM u WINDOW o AS (PARTITION BY w ORDER BY doc_id, start)),
bg AS (SELECT b.*, r.n > 1 AS again, r.first_doc, r.first_start FROM b JOIN r ON r.doc_id = b.doc_id AND r.start = b.start AND r.j = 0),
bn AS (SELECT *, again AND (unit OR (coalesce(lag(again) OVER o, true) AND coalesce(lead(again) OVER o, true))) AS gone FROM bg WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
away AS (SELECT * FROM bn WHERE gone),
gs AS (SELECT r.* FROM r ANTI JOIN away ON away.doc_id = r.doc_id AND away.i = r.i WHERE r.j > 0 AND r.n > 1),
cut AS (SELECT p.doc_id, p.i, string_agg(p.piece, '' ORDER BY p.j) FILTER (gs.j IS NULL) AS rest
        FROM p JOIN (SELECT DISTINCT doc_id, i FROM gs) USING (doc_id, i) LEFT JOIN gs ON gs.doc_id = p.doc_id AND gs.i = p.i AND gs.j = p.j GROUP BY p.doc_id, p.i),
left_ AS (SELECT l.doc_id, string_agg(CASE WHEN cut.doc_id IS NULL THEN l.line ELSE cut.rest END, chr(10) ORDER BY l.i) AS text
          FROM l LEFT JOIN cut ON cut.doc_id = l.doc_id AND cut.i = l.i ANTI JOIN away ON away.doc_id = l.doc_id AND l.start >= away.start AND l.start + length(l.line) <= away.stop
          WHERE cut.doc_id IS NULL OR regexp_matches(coalesce(cut.rest, ''), '[^\\x20\\x09-\\x0D]') GROUP BY l.doc_id),
says AS (SELECT doc_id, count(*) AS n, string_agg(concat(start, ':', stop, ':', first_doc, ':', first_start), ',' ORDER BY start) AS removed
         FROM (SELECT doc_id, start, stop, first_doc, first_start FROM away UNION ALL SELECT doc_id, start, stop, first_doc, first_start FROM gs) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_.text, '') END AS text,
       coalesce(says.n, 0)::BIGINT AS n_removed, coalesce(says.removed, '') AS removed
FROM documents d LEFT JOIN left_ USING (doc_id) LEFT JOIN says USING (doc_id)
"""
