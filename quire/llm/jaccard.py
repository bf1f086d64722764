"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed five-word shingles. Those with equal sets are one class, which its least document stands for.
Classes that share a band of MinHash values are candidates: 40 bands of 6 values miss a pair of similarity 0.8 with a
chance of 5e-6. Candidates are compared in tiles. A class's home is the largest band group that it is in; the classes of a
home make one block, or several of bounded size; and two blocks (or one with itself) make a tile if classes of both share
a band. Only such classes go into the tile, so a chain of templates, each like the next, takes tiles in proportion to its
length and not to the square, while a group of near copies of any size meets in a few blocks. Every pair falls into one
tile. There pairs that share a band are compared by MinHash values, 30 at a time, and dropped as soon as the posterior
probability of a similarity of at least the threshold, from a uniform prior, falls below the tolerance. What is left is
verified on the shingle sets. A tile returns counts of links and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytesops import ALNUM, LOWER, chunks, grams, mix64, words
from quire.llm.components import connected
from quire.llm.shared import durable, hint_small, text_key, without

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
K = BANDS * ROWS
STEP = 30
TOLERANCE = 1e-6
BLOCK = 512  # classes in one side of a tile
BLOCK_SHINGLES = 1_000_000  # and shingles, about
GROUP = 256  # classes and
GROUP_SHINGLES = 500_000  # shingles of small tiles that are compared in one call, about
PART, PART_BYTES = 500, 2_000_000  # texts and bytes of text that are shingled and signed at once; one text is never cut
MEMBERS = "node binary, signature binary, shingles binary"
SLIM = "doc_id long, tkey long, n_shingles long, node binary, bands array<long>"
LINKED = "node binary, root binary, n_texts long, n_docs long"
_A = (mix64(np.arange(1, K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(1001, K + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; a text of fewer words is one run."""
    for chunk in chunks(texts):
        found = words(chunk, ALNUM, LOWER)
        hashes, at = grams(found, n)
        cut = np.searchsorted(at, found.first)
        short = {m: grams(found, m) for m in set(found.counts[(found.counts > 0) & (found.counts < n)].tolist())}
        for i in range(len(chunk)):
            m = int(found.counts[i])
            if 0 < m < n:
                h, a = short[m]
                yield h[a == found.first[i]]
            else:
                yield np.unique(hashes[cut[i] : cut[i + 1]])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, K) MinHash values of sets that are not empty."""
    out = np.empty((K, len(sets)), np.uint32)
    if sets:
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for k in range(K):
            np.minimum.reduceat(flat * _A[k] + _B[k], starts, out=out[k])
    return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys that two sets share if all values of the band agree."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix64(key + signature[:, k])
        out[:, b] = key
    return out.view(np.int64)


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most PART rows and, unless it is one row, PART_BYTES of column text: bounds the memory of sets and signatures."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(batch):
        full = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_BYTES, "right"))
        b = max(a + 1, min(a + PART, full))
        yield batch.slice(a, b - a)
        a = b


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch, 2):
            sets = list(shingle_sets(part.column(2)))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures([sets[i] for i in full]))
            bands: list = [None] * len(sets)
            for i, k in zip(full, keys, strict=True):
                bands[i] = k
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64()))
                ],
                ["doc_id", "tkey", "n_shingles", "node", "bands"],
            )


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values the least matches with which a pair is still likely enough.

    With a uniform prior, the posterior after m of n matches is Beta(m + 1, n - m + 1), and its weight above t equals the
    chance of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, K + 1, STEP):
        below, m = (1 - threshold) ** (n + 1), 0
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature and shingle set of texts (node, text), both as bytes."""
    for batch in batches:
        for part in _parts(batch, 1):
            sets = list(shingle_sets(part.column(1)))
            cols = [part.column(0), pa.array([s.tobytes() for s in signatures(sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "signature", "shingles"])


def candidates(signature: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) matrix of the pairs that share a band; of one side with itself, each pair once."""
    if len(left) * len(right) <= 4096:  # few: compare each value at once
        equal = signature[left][:, None] == signature[right][None]
        out = equal.reshape(len(left), len(right), BANDS, ROWS).all(-1).any(-1)
    else:
        keys, out = band_keys(signature), np.zeros((len(left), len(right)), bool)
        for b in range(BANDS):
            place = np.argsort(keys[right, b], kind="stable")
            lo, hi = (np.searchsorted(keys[right[place], b], keys[left, b], side) for side in ("left", "right"))
            for i in np.flatnonzero(hi > lo):
                out[i, place[lo[i] : hi[i]]] = True
    return np.triu(out, 1) if left is right else out


def linked_pairs(
    sets: list[np.ndarray], signature: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD
) -> Iterator[tuple[int, np.ndarray]]:
    """For each i of left the j of right with a Jaccard similarity of at least threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least, pairs = least_matches(threshold), candidates(signature, left, right)
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *sizes[:-1]])
    marked = np.zeros(len(ids), bool)
    for n, i in enumerate(left):
        js = right[pairs[n]]
        js = js[(np.minimum(sizes[js], sizes[i]) >= threshold * np.maximum(sizes[js], sizes[i]) - 1e-9)]
        matches = np.zeros(len(js), np.int64)
        for k in range(0, K, STEP):
            if not len(js):
                break
            matches += (signature[js, k : k + STEP] == signature[i, k : k + STEP]).sum(1)
            on = matches >= least[k + STEP]
            js, matches = js[on], matches[on]
        if not len(js):
            continue
        mine = flat[starts[i] : starts[i] + sizes[i]]
        marked[mine] = True
        if len(js) * 4 > len(sets):
            common = np.add.reduceat(marked[flat].astype(np.int64), starts)[js]
        else:
            common = np.array([np.count_nonzero(marked[flat[starts[j] : starts[j] + sizes[j]]]) for j in js.tolist()], np.int64)
        marked[mine] = False
        js = js[common >= threshold * (sizes[js] + sizes[i] - common) - 1e-9]
        if len(js):
            yield int(i), js


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ta, tb, block, copies = (table.column(c).to_numpy() for c in ("ta", "tb", "block", "copies"))
        nodes = table.column("node").to_pylist()
        every = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        signed = np.stack([np.frombuffer(x, np.uint32) for x in table.column("signature").to_pylist()])
        order = np.lexsort((tb, ta))
        cuts = np.flatnonzero((np.diff(ta[order]) != 0) | (np.diff(tb[order]) != 0)) + 1
        out: list[tuple] = []
        for rows in np.split(order, cuts):
            a, b = ta[rows[0]], tb[rows[0]]
            n_texts, n_docs, root = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), list(range(len(rows)))

            def top(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            left = np.flatnonzero(block[rows] == a)
            right = left if a == b else np.flatnonzero(block[rows] == b)
            if not len(left) or not len(right):
                continue
            for i, js in linked_pairs([every[r] for r in rows], signed[rows], left, right, threshold):
                n_texts[i] += len(js)
                n_docs[i] += copies[rows[js]].sum()
                n_texts[js] += 1
                n_docs[js] += copies[rows[i]]
                for j in js.tolist():
                    x, y = top(i), top(j)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            for i in np.flatnonzero(n_texts).tolist():
                out.append((nodes[rows[i]], nodes[rows[top(i)]], int(n_texts[i]), int(n_docs[i])))
        cols, types = list(zip(*out, strict=True)) or [()] * 4, (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["node", "root", "n_texts", "n_docs"])

    return run


def tiles(classes: DataFrame) -> DataFrame:
    """(node, ta, tb, block, copies, group): which class goes into which tiles (ta <= tb), and as a row of which block.

    classes: node, n_shingles, copies, bands. Band groups, homes and blocks are handled as keys and counts only. A group is
    what one call compares: a large tile, or small ones of about GROUP classes and GROUP_SHINGLES shingles together.
    """
    banded = classes.select("node", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = durable(banded.join(hint_small(sizes, "jaccard-bands"), "key"), "jaccard-shared")
    home = shared.groupBy("node").agg(F.max(F.struct("n", "key")).alias("m")).select("node", F.col("m.key").alias("home"))
    housed = durable(home.join(classes.select("node", "copies", "n_shingles"), "node"), "jaccard-homes")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    n_blocks = hint_small(housed.groupBy("home").agg(blocks.alias("blocks")), "jaccard-blocks")
    number = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = housed.join(n_blocks, "home").select("node", "copies", "n_shingles", F.xxhash64("home", number).alias("block"))
    placed = hint_small(placed, "jaccard-placed")
    inside = durable(shared.select("node", "key").join(placed.select("node", "block"), "node"), "jaccard-inside")
    # Band groups as lists of blocks, not of classes: at most one in BLOCK of a large home's classes is a block of its own.
    each = inside.groupBy("key", "block").agg(F.count("*").alias("n"))
    lists = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("met"))
    met = hint_small(lists, "jaccard-met", F.size("met"))
    # The band groups of a dense group meet the same blocks, so their lists are put together before a class is dealt to them.
    other = F.transform(F.filter("met", lambda m: (m["block"] != F.col("block")) | (m["n"] > 1)), lambda m: m["block"])
    to = inside.join(met, "key").groupBy("node", "block").agg(F.array_distinct(F.flatten(F.collect_set(other))).alias("to"))
    rows = to.select("node", "block", F.explode("to").alias("other"))
    rows = rows.select("node", "block", F.least("block", "other").alias("ta"), F.greatest("block", "other").alias("tb"))
    rows = durable(rows.join(placed.drop("block"), "node"), "jaccard-tile-rows")
    totals = rows.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).first()
    bins = max(1, totals["n"] // GROUP, (totals["s"] or 0) // GROUP_SHINGLES)
    weights = rows.groupBy("ta", "tb").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_s"))
    large = weights.where((F.col("_n") > GROUP) | (F.col("_s") > GROUP_SHINGLES)).select("ta", "tb", F.lit(True).alias("alone"))
    group = F.when(F.col("alone"), F.xxhash64("ta", "tb")).otherwise(F.pmod(F.xxhash64("ta", "tb"), F.lit(bins)))
    return rows.join(hint_small(large, "jaccard-large"), ["ta", "tb"], "left").select("node", "ta", "tb", "block", "copies", group.alias("group"))


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey, class_id, copy_of, n_copies, n_text_links, n_links, is_head for every row of docs.

    Words are runs of ASCII letters and digits and other than ASCII characters, A-Z in lower case. class_id is the least
    doc_id of those that links lead to, n_links the number of other rows with a similarity of at least threshold (copies
    included), is_head whether the row stands for its class, n_text_links the number of different shingle sets among them,
    copy_of the least doc_id with the same set and n_copies the rows with it. Every pair of different sets is counted; none is returned. Texts without words (null,
    empty) are linked to nothing and are classes of their own. Rows that repeat an id count as rows. Null ids come after
    all others. Other columns are ignored. threshold must be 0.8 or more for the bands' chance of a miss to hold.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text_key().alias("tkey"), "text")
    slim = durable(keyed.mapInArrow(_slim, SLIM), "jaccard-slim")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tkey"))
    equal = slim.where("node is not null").groupBy("node")
    equal = equal.agg(first.alias("f"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    rep = (F.col("f.doc_id").alias("rep_id"), F.col("f.tkey").alias("rep_key"))
    classes = durable(equal.select("node", *rep, "copies", "n_shingles", "bands"), "jaccard-classes")
    placed = hint_small(tiles(classes), "jaccard-tiles")
    # Every class that has a candidate is shingled and signed once; its tiles get the results, not the text.
    needed = hint_small(placed.select("node").distinct().join(classes.select("node", "rep_id", "rep_key"), "node"), "jaccard-needed")
    texts = keyed.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), "text")
    if _repeats(slim):
        texts = texts.dropDuplicates(["_id", "_key"])
    chosen = texts.join(needed, texts["_id"].eqNullSafe(needed["rep_id"]) & (texts["_key"] == needed["rep_key"])).select("node", "text")
    # Signatures and sets, larger than the text, are read once, by the tiles: they are shuffled there and not written before.
    members = chosen.mapInArrow(_members, MEMBERS)
    compared = durable(members.join(placed, "node").groupBy("group").applyInArrow(_compare(threshold), LINKED), "jaccard-links")
    counts = compared.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    label = connected(compared.select(F.col("node").alias("u"), F.col("root").alias("v")), "jaccard-classes")
    named = classes.select("node", "rep_id", "rep_key", "copies").join(label, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = durable(named, "jaccard-named")
    heads = named.groupBy("label").agg(F.min(F.struct(F.isnull("rep_id").alias("none"), "rep_id", "rep_key")).alias("head"))
    info = named.join(heads, "label").select(
        F.col("node").alias("_node"), F.col("head.rep_id").alias("class_id"), F.col("head.rep_key").alias("class_key"), "rep_id", "copies", "n_texts",
        "n_docs"
    )
    zero = F.lit(0).cast("long")
    return slim.join(info, slim["node"] == info["_node"], "left").select(
        "doc_id",
        "tkey",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")).alias("copy_of"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("n_texts", zero).alias("n_text_links"),
        (F.coalesce("copies", F.lit(1).cast("long")) - 1 + F.coalesce("n_docs", zero)).alias("n_links"),
        (F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tkey") == F.col("class_key")))).alias("is_head"),
    )


def one_of_each(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns: the one with the least doc_id of each.

    Of rows that repeat an id and its text one stays. Texts without words (null, empty, blank) are no copies of each other
    and stay, but for rows that repeat their id; rows without id come after all others; no rows give none.
    """
    found = durable(near_duplicates(docs, threshold=threshold), "jaccard-found")
    heads = found.where("is_head")
    left = without(docs, found.where("not is_head"))
    row = heads.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "tkey").alias("d")).first()
    if row["n"] == row["d"]:
        return left
    # Rows that repeat an id and its text: one of them stays. Rows without words are no copies of each other but by id.
    return left.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key")).dropDuplicates(["_id", "_key"]).select("_row.*")


def _repeats(slim: DataFrame) -> bool:
    row = slim.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "tkey").alias("d")).first()
    return row["n"] > row["d"]

ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
k AS (SELECT doc_id, ss, md5(array_to_string(list_sort(ss), '|')) AS c FROM s),
cls AS (SELECT c, min(doc_id) AS rep, count(*) AS copies, any_value(ss) AS ss FROM k WHERE len(ss) > 0 GROUP BY c),
e AS (SELECT rep, unnest(ss) AS sh FROM cls),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS m FROM e x JOIN e y ON x.sh = y.sh AND x.rep < y.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN cls x ON x.rep = a JOIN cls y ON y.rep = b WHERE m >= 0.8 * (len(x.ss) + len(y.ss) - m) - 1e-9),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a AS rep, count(*) AS nt, sum(copies) AS nd FROM d JOIN cls ON rep = b GROUP BY a),
r(a, b) AS (SELECT rep, rep FROM cls UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b),
g AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a)
SELECT k.doc_id, coalesce(g.class_id, k.doc_id) AS class_id, coalesce(cls.rep, k.doc_id) AS copy_of, coalesce(copies, 1) AS n_copies, coalesce(nt, 0) AS n_text_links,
       (coalesce(copies, 1) - 1 + coalesce(nd, 0))::BIGINT AS n_links
FROM k LEFT JOIN cls ON cls.c = k.c AND len(k.ss) > 0 LEFT JOIN g ON g.rep = cls.rep LEFT JOIN n ON n.rep = cls.rep
"""
