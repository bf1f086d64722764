"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts up to four bytes long, with counts of what followed. A byte costs -log2 of its
probability in the longest context that the language has seen; a context that has not been followed by it costs an escape
(method C: as many escapes as different followers) and passes the byte to the next shorter one, down to 1/256. A text's
code length in a language is the sum over its bytes, and the shortest wins. The counts are frozen after training.

All languages are scored at once: runs of five bytes that any language has seen are rows of a table that holds every
language's whole cost, escapes included; a run that none has seen adds each language's escape and falls to the shorter run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bytesops import byte_class, chunks
from quire.llm.shared import text_key

ORDER = 4
TRAIN_DOCS = 1_000  # about so many documents a language are learned from
TRAIN_BYTES = 4_000_000  # and at most about so many bytes of them
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
PREDICTED = "doc_id long, tkey long, lang_pred string, score double"


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte letters from U+00C0 to U+00DE; every byte but those stays."""
    out = data + np.where(byte_class((0x41, 0x5A))[data], 32, 0).astype(np.uint8)
    capital = byte_class((0x80, 0x96), (0x98, 0x9E))[data[1:]] & (data[:-1] == 0xC3)
    out[1:][capital] += 32
    return out


def runs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The run of ORDER + 1 bytes that ends at each byte, as an integer, first byte highest.

    Before a text stand newlines: so many bytes of every text are masked as belong to the text before it.
    """
    x = data.astype(np.uint64)
    out = x.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(x), 10, np.uint64)
        before[k:] = x[:-k]
        for j in range(k):  # the j-th byte of a text has no k-th byte before it
            i = at[:-1] + j
            i = i[i < at[1:]]
            before[i] = 10
        out |= before << np.uint64(8 * k)
    return out


def _texts_only(chunk) -> np.ndarray:
    keep = np.ones(len(chunk.data), bool)
    keep[chunk.at[1:] - 1] = False
    return keep


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for chunk in chunks(batch.column(1)):
            grams, keep = runs(fold(chunk.data), chunk.at), _texts_only(chunk)
            lang = np.repeat(langs[chunk.first : chunk.first + len(chunk)], np.diff(chunk.at))
            for name in dict.fromkeys(langs[chunk.first : chunk.first + len(chunk)]):
                values, n = np.unique(grams[keep & (lang == name)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "run", "n"]
                )


class _Table:
    """Open hash table from integer keys to rows, searched for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.row, self.key = np.full(size, -1, np.int32), np.zeros(size, np.uint64)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):  # of the keys that meet in a free slot one stays, the others move on
            free = self.row[slot[left]] < 0
            _, first = np.unique(slot[left][free], return_index=True)
            won = left[free][first]
            self.row[slot[won]], self.key[slot[won]] = won, keys[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._home(keys)
        row = self.row[slot]
        out = np.where((row >= 0) & (self.key[slot] == keys), row, -1)
        left = np.flatnonzero((row >= 0) & (out < 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.row) - 1)
            row = self.row[slot]
            hit = (row >= 0) & (self.key[slot] == keys[left])
            out[left[hit]] = row[hit]
            on = (row >= 0) & ~hit
            left, slot = left[on], slot[on]
        return out


class Model:
    """Frozen PPM statistics of all languages.

    For each order: seen, the runs (context and byte) that any language has seen, with every language's cost in bits;
    escape, the contexts that any has seen, with every language's cost of leaving them (0 where it has not seen them).
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        self.levels: list[tuple[_Table, np.ndarray, _Table, np.ndarray]] = []  # from order 0 up
        for order in range(ORDER + 1 if counts else 0):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            own = []
            for lang in self.langs:
                keys, inverse = np.unique(counts[lang][0] & mask, return_inverse=True)
                own.append((keys, np.bincount(inverse, counts[lang][1], len(keys))))
            keys = np.unique(np.concatenate([k for k, _ in own]))
            contexts = np.unique(keys >> np.uint64(8))
            escape, cost = np.zeros((len(contexts), n_langs)), np.zeros((len(keys), n_langs))
            lower = self._cost(keys & (mask >> np.uint64(8)), order - 1)
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            for i, (k, n) in enumerate(own):
                c = np.searchsorted(contexts, k >> np.uint64(8))
                total, kinds = np.bincount(c, n, len(contexts)), np.bincount(c, minlength=len(contexts))
                known = kinds > 0
                escape[known, i] = np.log2((total + kinds)[known] / kinds[known])
                cost[:, i] = lower[:, i] + escape[of, i]
                cost[np.searchsorted(keys, k), i] = np.log2((total + kinds)[c] / n)
            self.levels.append((_Table(keys), cost, _Table(contexts), escape))

    def _cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Every language's cost, in the context of order bytes, of the last byte of each run."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        seen, cost, contexts, escape = self.levels[order]
        row = seen.find(keys)
        out = cost[row]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            context = contexts.find(keys[missing] >> np.uint64(8))
            left = np.where((context >= 0)[:, None], escape[context], 0.0)
            out[missing] = left + self._cost(keys[missing] & np.uint64((1 << (8 * order)) - 1), order - 1)
        return out

    def code_lengths(self, chunk) -> np.ndarray:
        """(texts, languages): bits of each text in each language. Long chunks are costed piece by piece."""
        keys, keep = runs(fold(chunk.data), chunk.at), _texts_only(chunk)
        out = np.zeros((len(chunk), len(self.langs)))
        piece = max(1 << 12, (1 << 20) // len(self.langs))
        for a in range(0, len(keys), piece):
            b = min(a + piece, len(keys))
            cost = self._cost(keys[a:b], ORDER)
            cost[~keep[a:b]] = 0
            i, j = np.searchsorted(chunk.at, [a, b - 1], "right") - 1
            out[i : j + 1] += np.add.reduceat(cost, np.maximum(chunk.at[i : j + 1], a) - a, axis=0)
        return out


def train(labelled: DataFrame, *, per_lang: int = TRAIN_DOCS) -> Model:
    """Learns from about per_lang documents of each language of labelled (doc_id, text, lang), chosen by a hash of the id.

    The share of a language's documents that is taken follows from its number of documents and of bytes, so what reaches
    the driver is bounded by the sample, whatever the corpus. Of every language at least the document with the least hash
    is taken, so that none that has a labelled document is missing. Equal rows are taken together; null texts count as empty.
    """
    # Rows without id are told apart by their texts.
    name = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    placed = labelled.withColumn("_place", F.pmod(name, F.lit(1 << 30)) / float(1 << 30))
    sizes = placed.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("_place").alias("least"))
    shares = {r["lang"]: max(r["least"], min(1.0, per_lang / r["n"], TRAIN_BYTES / max(r["bytes"] or 0, 1))) for r in sizes.collect()}
    if not shares:
        return Model({})
    share = F.lit(0.0)
    for lang, s in shares.items():
        share = F.when(F.col("lang") == lang, s).otherwise(share)
    sample = placed.where(F.col("_place") <= share).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    langs, found, n = (counted.column(i).to_numpy() for i in range(3))
    return Model({lang: (found[langs == lang].astype(np.uint64), n[langs == lang]) for lang in dict.fromkeys(langs)})


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            for chunk in chunks(batch.column(2)):
                bits = model.code_lengths(chunk) if model.langs else np.zeros((len(chunk), 0))
                lettered = chunk.per_text(_LETTER[chunk.data]) > 0
                for i in range(len(chunk)):
                    if not lettered[i]:
                        text = batch.column(2)[chunk.first + i].as_py() or ""
                        lettered[i] = any(c.isalpha() for c in text)
                    if not lettered[i] or not model.langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    best = int(np.argmin(bits[i]))
                    pred.append(model.langs[best])
                    score.append(float(np.round(1 / np.exp2(np.maximum(bits[i][best] - bits[i], -1000)).sum(), 6)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "tkey", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey, lang_pred, score for every row of docs, from the whole text alone.

    score is the posterior of the predicted language under equal priors. A null text and one without a letter are `und`,
    score 0, as is every text if there was nothing to learn from. Equal code lengths go to the first language by name.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text_key().alias("tkey"), "text")
    return keyed.mapInArrow(_predict(model), PREDICTED)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether the id is one that is never learned from; a null id counts as the empty text."""
    name = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(name.cast("string"), F.lit("")), "utf-8")) % 4 == 2
