"""Vectorised work on the UTF-8 bytes of many texts at once: words, word hashes, shingles, sums per document.

Texts are handled in chunks of a quarter of a megabyte, so memory does not follow the size of a batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_M = 0x9E3779B97F4A7C15  # any odd number: it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the bytes in these inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Words as runs of other characters than ASCII whitespace.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of ASCII letters, digits and any other than ASCII characters.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A to Z.
LOWER = np.arange(256, dtype=np.uint8) + np.where(byte_class((0x41, 0x5A)), 32, 0).astype(np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that what Python makes of one stays small."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


@dataclass
class Chunk:
    """Some consecutive texts, each followed by a newline in data. Text i is data[at[i] : at[i + 1] - 1]."""

    first: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of values, one for each byte of data, by text."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Nulls count as empty texts."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        at = ends[i : j + 1] - ends[i] + np.arange(j - i + 1)
        out = np.full(at[-1], 10, np.uint8)
        keep = np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        out[keep] = raw[ends[i] : ends[j]]
        yield Chunk(i, out, at)
        i = j


@dataclass
class Words:
    """Words of a chunk: byte bounds, hashes, and for every text the number of its first word (one more at the end)."""

    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _raised(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, m in enumerate((_M, pow(_M, -1, 1 << 64))):
            up = np.full(size, m, np.uint64)
            up[0] = 1
            _powers[k] = np.cumprod(up)
    return _powers


def words(chunk: Chunk, letters: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """letters: table of the bytes that make words; fold: what each byte counts as in the hashes.

    A hash is a polynomial in the word's bytes modulo 2**64, read off running sums over the chunk, then mixed.
    """
    inside = letters[chunk.data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, stop = edge[0::2], edge[1::2]  # a text ends in a newline, so every word ends
    up, down = _raised(len(chunk.data) + 1)
    sums = np.zeros(len(chunk.data) + 1, np.uint64)
    np.cumsum(_BYTE[fold][chunk.data] * up[: len(chunk.data)], out=sums[1:])
    return Words(start, stop, np.searchsorted(start, chunk.at), mix64((sums[stop] - sums[start]) * down[start]))


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within a text, and the number of each run's first word."""
    h = found.hashes
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = found.doc()
    at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k]
    return mix64(out[at]), at


class HashSet:
    """Finds members of a fixed set of hashes: a bit table by high bits first, a sorted list for what passes."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.asarray(values, np.uint64))
        self.shift = np.uint64(64 - min(26, max(12, (8 * len(self.values)).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.values >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in hashes members stand, and the members' numbers."""
        at = np.flatnonzero(self.bits[(hashes >> self.shift).astype(np.int64)])
        if not len(self.values) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        good = self.values[k] == hashes[at]
        return at[good], k[good]
