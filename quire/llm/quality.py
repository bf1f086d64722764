"""Quality rules: base measures of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed runs of four bytes are compared: one of trusted documents (labelled quality 1, a bounded
sample), one of the whole raw corpus. A document's score is the mean of log(p_target / p_raw) over its runs, so long and
short texts compare. The threshold is the one cut of the labelled documents' scores that tells quality 1 from 0 best, and
the same number is applied to every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytesops import SPACED, byte_class, chunks, grams, slices, words
from quire.llm.shared import durable, text_key

BUCKETS = 1 << 16
N = 4
TRUSTED = 50_000  # at most so many labelled documents of quality 1 fit the target multinomial
SMOOTHING = 1.0
SYMBOLS = sum((byte_class((b, b)) for b in b"#*$%&|<>"), np.zeros(256, bool))
LEAD = ~byte_class((0x80, 0xBF))  # bytes that begin a code point
BASE = "doc_id long, tkey long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SPACE = " \t\n\x0b\x0c\r"


def buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the run of N bytes that begins at each byte (the last runs end in zeros)."""
    x = np.zeros(len(data) + N - 1, np.uint32)
    x[: len(data)] = data
    run = x[: len(data)].copy()
    for k in range(1, N):
        run |= x[k : len(data) + k] << np.uint32(8 * k)
    return (run * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _inner(chunk) -> np.ndarray:
    """1 for the bytes at which a run of N bytes of one text begins, else 0."""
    inner = np.ones(len(chunk.data), bool)
    ends = chunk.at[1:] - 1
    for k in range(N):
        inner[np.maximum(ends - k, chunk.at[:-1])] = False
    return inner


def _repeat_words(found, n: int = 5) -> np.ndarray:
    """By text: words inside runs of n words that the text has twice or more."""
    out = np.zeros(len(found.first) - 1, np.int64)
    h, at = grams(found, n)
    if not len(h):
        return out
    doc = found.doc()
    order = np.lexsort((h, doc[at]))
    same = (h[order[1:]] == h[order[:-1]]) & (doc[at[order[1:]]] == doc[at[order[:-1]]])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(found.hashes) + 1, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + n, -1)
    np.add.at(out, doc[np.cumsum(steps)[:-1] > 0], 1)
    return out


def _dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for chunk in chunks(texts):
            found = words(chunk, SPACED)
            inside = SPACED[chunk.data] & LEAD[chunk.data]
            for c, v in zip(cols, (found.counts, chunk.per_text(inside), chunk.per_text(SYMBOLS[chunk.data]), _repeat_words(found)), strict=True):
                c.append(v)
        n_words, word_chars, n_symbols, n_repeat = (pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols)
        dup = pa.array([_dup_lines(t.as_py() or "") for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), n_words, word_chars, n_symbols, dup, n_repeat],
            ["doc_id", "tkey", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        )


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = np.array(batch.column(1).to_pylist(), bool)
        for chunk in chunks(batch.column(0)):
            b, inner = buckets(chunk.data), _inner(chunk)
            raw += np.bincount(b[inner], minlength=BUCKETS)
            mine = np.repeat(trusted[chunk.first : chunk.first + len(chunk)], np.diff(chunk.at))
            target += np.bincount(b[inner & mine], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for chunk in chunks(batch.column(2)):
                b, inner = buckets(chunk.data), _inner(chunk)
                scores.append(chunk.per_text(np.where(inner, ratio[b], 0)) / np.maximum(chunk.per_text(inner), 1))
            # Rounded, so that it does not matter which texts stand before one in a chunk.
            score = np.round(np.concatenate(scores), 6) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "tkey", "score"])

    return run


def measures(keyed: DataFrame) -> DataFrame:
    """Base measures for each row of (doc_id, tkey, text), repeated ones too. Null texts count as empty: all measures 0."""
    return keyed.mapInArrow(_measure, BASE)


def _both(ratio: np.ndarray):
    scored = _score(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            base, score = next(_measure(iter([batch]))), next(scored(iter([batch])))
            yield base.append_column("score", score.column(2))

    return run


def log_ratio(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) by bucket; docs: (doc_id, text), trusted: (doc_id), bounded. The raw counts are of all documents."""
    marked = docs.join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left")
    flagged = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    rows = flagged.mapInArrow(_histogram, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    ).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    p = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)
    return np.log(p(target) / p(raw))


def best_cut(counts: list[tuple[float, int, int]]) -> float:
    """The cut, between two scores, with the most rows of quality 1 at or above and of quality 0 below, by shares.

    counts: (score, rows of quality 1, rows of quality 0). Of equal cuts the lowest is taken, so a tie keeps documents.
    Without both qualities nothing is cut.
    """
    good, bad = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not good or not bad:
        return float("-inf")
    best, cut, good_below, bad_below, previous = 0.0, float("-inf"), 0, 0, None
    for score, g, b in sorted(counts):
        gain = bad_below / bad - good_below / good
        if previous is not None and gain > best + 1e-12:
            best, cut = gain, (previous + score) / 2
        good_below, bad_below, previous = good_below + g, bad_below + b, score
    return cut


def judge(docs: DataFrame, labels: DataFrame, *, trusted: int = TRUSTED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey, the base measures, score, base_failed and kept for every row of docs.

    labels: (doc_id, quality). base_failed: fewer than 10 words, or over 20 % of them in repeated runs of five words. kept:
    not base_failed and a score not below the threshold. Null texts have no words and fail. Without labels of quality 1
    all scores are 0, and without labels of both qualities every document that does not fail is kept. Rows that repeat an
    id are judged each by their text. Other columns are ignored.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text_key().alias("tkey"), "text")
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    ).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    ratio = log_ratio(keyed, sample)
    scored = durable(keyed.mapInArrow(_both(ratio), BASE + ", score double"), "quality-scores")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = scored.withColumn("base_failed", base_failed)
    bins = judged.where("not base_failed").join(known, "doc_id").groupBy(F.round("score", 3).alias("score")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    cut = best_cut([(r["score"], r["good"], r["bad"]) for r in bins.collect()])  # scores lie within +-12: few thousand bins
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))
