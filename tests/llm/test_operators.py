"""Every operator against its brute-force version on the small driver tables."""

import base64
import hashlib
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chunk_dedup, decontamination, jaccard, langid, mixing, pii, quality, queries, sharding, shared, substring_dedup
from quire.llm.bytesops import chunks
from quire.sources import tables
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, sf, name):
    return {r[0]: r for r in queries.queries()[name](spark, sf).collect()}


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_substring_dedup(spark, table):
    frame = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    got = {r.doc_id: (r.text, r.n_removed, r.removed) for r in queries.op1_substring_dedup(spark, f"/root/testdata/{table}").collect()}
    assert got == brute.substring_dedup(docs)
    assert any(r[1] for r in got.values())


def test_passages_are_found_inside_of_lines(spark):
    passage = "Nobody in the town saw who had been there at nine o'clock. So. By morning the boats were gone and the sea was flat."
    line = "the sea was  FLAT and by morning the boats were gone from the pier."
    rows = [
        (1, f"Some other words stand here before it. {passage}\nAn end of its own in every document.\n{line}"),
        (2, f"{passage} Then there are words behind it as well."),
        (3, "Nobody in the town saw who. This is all that it shares."),
        (4, f"Now. {line.upper()} Then. Now."),
    ]
    got = {r.doc_id: r for r in substring_dedup.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text == " So. Then there are words behind it as well." and got[2].n_removed == 2
    assert got[2].removed.split(",")[0] == f"0:58:1:{rows[0][1].index(passage) - 1}"
    assert got[3].text == rows[2][1]
    assert got[4].text == "Now. Then. Now." and got[4].n_removed == 1  # a sentence equal to another's line


def test_paragraphs_of_short_lines(spark):
    """Shorter lines are compared as paragraphs; a few of them go only where they are repeated beside units that go."""
    marks = "\n".join(" ".join(f"word{i + k}!!" for k in range(8)) for i in range(20))
    first, last = "A line of more than ten words that stands first in here, and then some.", "And another line of more than ten words that stands last in this text."
    rows = [
        (1, marks),
        (2, f"{marks}\n\n{first}"),
        (3, f"{first}\nYes.\nNo.\n{last}"),
        (4, f"{first}\nyes.\n\nNO.\n{last}"),
        (5, f"{first}\nYes. But no.\n{last}\nYes."),
        (6, "Yes."),
        (7, " yes. "),
        (8, "Yes.\nBut this one line stands nowhere else in all of these texts."),
    ]
    got = {r.doc_id: r for r in substring_dedup.drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == marks and got[1].n_removed == 0
    assert got[2].text == f"\n{first}" and got[2].removed == f"0:{len(marks)}:1:0"
    assert got[3].text == f"Yes.\nNo.\n{last}" and got[3].removed == f"0:{len(first)}:2:{len(marks) + 2}"
    assert got[4].text == "" and got[4].n_removed == 3
    assert got[5].text == "Yes. But no.\nYes." and got[5].n_removed == 2  # neither of the two stands earlier in a text or paragraph
    assert got[6].text == "" or got[6].n_removed == 0
    assert got[7].text == "" and got[7].removed.startswith("0:6:")
    assert got[8].text == rows[7][1]


def test_no_unit_stands_twice(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = result(spark, sf, "op1_substring_dedup")
    first = {}
    copies = [k for k in sorted(docs) if first.setdefault(docs[k], k) != k]
    assert copies and not any(got[k].text.strip() for k in copies)
    untouched, everywhere = Counter(), Counter()
    for k, text in docs.items():
        cuts, at = [tuple(map(int, x.split(":")[:2])) for x in got[k].removed.split(",") if x], 0
        for line in text.split("\n"):
            words = " ".join(line.lower().split())
            everywhere[words] += 1
            if words.count(" ") >= 9 and not any(a < at + len(line) and at < b for a, b in cuts):
                untouched[words] += 1
            at += len(line) + 1
    assert untouched and max(untouched.values()) == 1 and any(n > 1 for x, n in everywhere.items() if x.count(" ") >= 9)
    for k, text in docs.items():  # what is left is the original without the spans
        cuts, place, rest = sorted(tuple(map(int, x.split(":")[:2])) for x in got[k].removed.split(",") if x), 0, ""
        for a, b in cuts:
            rest, place = rest + text[place:a], b
        assert "".join((rest + text[place:]).split()) == "".join(got[k].text.split())


def test_personal_data(spark, sf, docs):
    got = result(spark, sf, "op2_pii_spans")
    some = 0
    for doc_id, text in docs:
        r, spans = got[doc_id], brute.pii(text)
        some += len(spans)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        kinds = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r.spans.split(","))
    assert some


def test_mixing(spark, sf, docs):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert {r.doc_id: r.size for r in rows} == {d: len(brute.SPACED.findall(t or "")) for d, t in docs}
    targets = brute.targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixing_budgets_nest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = {r.doc_id for r in mixing.mix(docs, share=0.2).collect() if r.copies}
    many = {r.doc_id for r in mixing.mix(docs, share=0.5).collect() if r.copies}
    assert few and few <= many


def test_chunk_dedup(spark, sf, docs):
    got = result(spark, sf, "op4_line_chunk_dedup")
    assert {k: (r.text, r.n_removed, r.removed) for k, r in got.items()} == brute.chunk_dedup(docs, chunk_dedup.split_chunks)
    assert any(r.n_removed for r in got.values())


def test_exact_copies_are_whole_chunks(spark):
    """Every chunk is a candidate, also a text of one line, so that nothing of a copy stays."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for text in [*docs.values(), "one line", "one line\n", "a\n\nb\n\n\nc", "\n\na\n"]:
        parts = list(chunk_dedup.split_chunks(text))
        assert "".join(text[a:b] for a, b, _ in parts) == text
        worded = sum(bool(line.strip()) for line in text.split("\n"))
        assert all(n >= 2 for *_, n in parts) or not worded
        assert sum(n for *_, n in parts) == worded or (len(parts) == 1 and worded < 2)
    got = {r.doc_id: r for r in queries.op4_line_chunk_dedup(spark, "/root/testdata/sf0.01").collect()}
    first = {}
    copies = [k for k in sorted(docs) if first.setdefault(docs[k], k) != k]
    assert copies and not any(got[k].text.strip() for k in copies)
    rows = [(1, "one line alone"), (2, "one line alone"), (3, "  "), (4, "  ")]
    got = {r.doc_id: r.text for r in chunk_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "one line alone", 2: "", 3: "  ", 4: "  "}


def test_chunks_resist_shifts():
    lines = [f"line {i} of a passage that stands in several documents" for i in range(40)]
    parts = lambda text: {text[a:b].rstrip("\n") for a, b, _ in chunk_dedup.split_chunks(text)}
    one, other = "\n".join(lines), "\n".join(["another beginning", *lines, "another end"])
    assert len(parts(one) & parts(other)) >= len(parts(one)) - 2
    assert "".join(other[a:b] for a, b, _ in chunk_dedup.split_chunks(other)) == other


def test_no_window_survives(spark):
    """The stage leaves no run of 13 words of an item, however little of a document it is, and takes nothing else."""
    sf = "/root/testdata/sf0.01"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    kept = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, frame, sf).collect()}
    wins = {tuple(ws[i : i + 13]) for ws in (brute.alnum(t) for _, t in items) for i in range(max(len(ws) - 13, 0) + 1)}
    has = lambda text: any(tuple(ws[i : i + 13]) in wins for ws in [brute.alnum(text)] for i in range(len(ws)))
    dirty = {d for d, t in docs if has(t)}
    assert dirty and set(kept) == {d for d, _ in docs} - dirty


def test_bit_table(spark):
    values = np.random.default_rng(1).integers(0, 1 << 64, 3000, dtype=np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "shingle long")
    table = decontamination.bit_table(frame)
    assert table.has(values).all()
    assert table.has(np.random.default_rng(2).integers(0, 1 << 64, 3000, dtype=np.uint64)).mean() < 0.05
    assert not decontamination.bit_table(frame.limit(0)).has(values).any()


@pytest.mark.parametrize("block_size", [200_000, 300])
def test_decontamination(spark, sf, docs, block_size):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontamination.report(spark.read.parquet(f"{sf}/documents.parquet"), bench, block_size=block_size).collect()
    want = brute.decontaminate(docs, [(r.item_id, r.text) for r in bench.collect()])
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert any(r.n_hit for r in got)


def test_quality(spark, sf, docs):
    got = result(spark, sf, "op6_quality_rules")
    for doc_id, text in docs:
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_base(text)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = brute.likelihood_scores(docs, {d for d, q in labels.items() if q == 1})
    for d, r in got.items():
        assert r.score == pytest.approx(want[d], abs=2e-6)
    good = [r.kept for d, r in got.items() if labels.get(d) == 1 and not r.base_failed]
    bad = [r.kept for d, r in got.items() if labels.get(d) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_best_cut():
    assert quality.best_cut([(-2.0, 0, 5), (-1.0, 0, 1), (0.0, 9, 0)]) == -0.5
    assert quality.best_cut([(0.0, 9, 0)]) == float("-inf")
    assert quality.best_cut([]) == float("-inf")


def test_hilbert_curve_visits_neighbours():
    bits = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_sharding(spark, sf, docs):
    rows = queries.queries()["op7_hilbert_sharding"](spark, sf).collect()
    text = dict(docs)
    slots = defaultdict(list)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    along = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in along] == sorted(r.curve for r in rows)


def test_write_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, sharding.shard(docs, 4), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_write_mixed_shards(spark, sf, tmp_path):
    """A mix repeats rows; all of them are written, also beside columns that are called shard and slot."""
    rows = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(None))
    n = rows.count()
    want = Counter(r.doc_id for r in rows.collect())
    assert n > len(want)
    for name, shards in (("number", 4), ("assignment", sharding.shard(rows, 4))):
        sharding.write_shards(rows, shards, f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert Counter(r.doc_id for r in back) == want
        per = Counter(r.shard for r in back)
        assert len({(r.shard, r.slot) for r in back}) == n and max(per.values()) - min(per.values()) <= 1
    first = next((tmp_path / "number" / "shard=2").glob("*.parquet"))
    slots = [r.slot for r in spark.read.parquet(str(first)).collect()]
    assert slots == sorted(slots)


def test_steps_are_quantiles(spark):
    frame = spark.createDataFrame([(f"s{i:03d}",) for i in range(200) for _ in range(1 + i % 3)] + [(None,)], "source string")
    step = {r.source: r.s for r in frame.select("source", sharding._step(frame, "source").alias("s")).collect()}
    values = [step[k] for k in sorted(k for k in step if k)]
    assert values == sorted(values) and set(Counter(values).values()) <= {6, 7} and len(set(values)) == 32
    assert {r.s for r in frame.limit(0).union(frame.where("source is null")).select(sharding._step(frame.limit(0), "source").alias("s")).collect()} == {0}


def test_near_duplicates(spark, docs):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small = [(r.doc_id, r.text) for r in frame.collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(frame).collect()}
    want = brute.near_duplicates(small)
    assert got == want
    assert any(links for _, links in want.values())


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """A component of more classes than a block is compared in tiles and loses no link."""
    base = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join(base[:d] + [f"x{d}"] + base[d + 1 :])) for d in range(60)] + [(100 + d, " ".join(base)) for d in range(3)]
    rows += [(200 + d, " ".join(f"v{d}{i}" for i in range(50))) for d in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(frame).collect()}
    assert got == brute.near_duplicates(rows)


def test_chains_take_tiles_in_proportion(spark, monkeypatch):
    """Documents of a chain, each like the next at 0.6, are one component of candidates; compared are those near each other."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    n, step = 600, 30
    stream = [f"w{i}" for i in range(step * n + 150)]
    rows = [(d, " ".join(stream[d * step : d * step + 124])) for d in range(n)]
    slim = spark.createDataFrame([(d, 0, t) for d, t in rows], "doc_id long, tkey long, text string").mapInArrow(jaccard._slim, jaccard.SLIM)
    placed = jaccard.tiles(slim.selectExpr("node", "n_shingles", "1L as copies", "bands")).collect()
    sides = Counter((r.ta, r.tb, r.block) for r in placed)
    pairs = sum(sides[a, b, a] * (sides[a, b, a] - 1) // 2 if a == b else sides[a, b, a] * sides[a, b, b] for a, b in {(r.ta, r.tb) for r in placed})
    near = {}
    for r in slim.collect():
        for k in r.bands:
            near.setdefault(k, set()).add(bytes(r.node))
    candidates = {frozenset((a, b)) for ns in near.values() for a in ns for b in ns if a < b}
    assert len(candidates) > n / 2 and pairs < 3 * len(candidates) and len(placed) < 20 * n
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_candidates_are_pairs_that_share_a_band():
    """Both ways of finding them, for one side with itself and for two."""
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(10)]
    sets = [np.unique(np.concatenate([base[i % 10][: 25 + i % 13], rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for i in range(140)]
    signature = jaccard.signatures(sets)
    keys = jaccard.band_keys(signature)
    want = (keys[:, None] == keys[None]).any(-1)
    some, all_, rest = np.arange(30), np.arange(140), np.arange(30, 140)
    assert (jaccard.candidates(signature, some, rest[:60]) == want[np.ix_(some, rest[:60])]).all()
    assert (jaccard.candidates(signature, all_, all_) == np.triu(want, 1)).all()
    assert (jaccard.candidates(signature, rest, some[:20]) == want[np.ix_(rest, some[:20])]).all()
    assert (jaccard.candidates(signature, rest, all_) == want[np.ix_(rest, all_)]).all() and want.sum() > 200


def test_near_duplicates_write_tables_once(spark, monkeypatch):
    """Signatures and sets of shingles, which only the tiles read, are no table, and no table is a selection of another."""
    written = []

    def noted(df, name):
        written.append((name, set(df.columns)))
        return tables.durable(df, name)

    monkeypatch.setattr(jaccard, "durable", noted)
    monkeypatch.setattr(shared, "durable", noted)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(frame).collect()}
    assert got == brute.near_duplicates([(r.doc_id, r.text) for r in frame.collect()])
    own = [(name, columns) for name, columns in written if not name.startswith("jaccard-classes-")]
    assert not [name for name, columns in own if columns & {"signature", "shingles"}]
    assert not {"jaccard-block-of", "jaccard-weights"} & {name for name, _ in own} and len(own) == 15


def test_shingling_is_bounded_by_bytes():
    """Long texts are shingled few at a time, with the same results; rows are never lost or cut."""
    rng = np.random.default_rng(7)
    texts = [None, ""] + [" ".join(f"w{i}" for i in rng.integers(0, 1 << 40, 10_000)) for _ in range(100)] + ["a b c"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["doc_id", "tkey", "text"])
    tracemalloc.start()
    got = [row for part in jaccard._slim(iter([batch])) for row in part.select(["doc_id", "n_shingles"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert [r["n_shingles"] for r in got] == [0, 0] + [9_996] * 100 + [1]
    full = pa.record_batch([pa.array([b"n"] * 101), pa.array(texts[2:])], ["node", "text"])
    sets = [row["shingles"] for part in jaccard._members(iter([full])) for row in part.to_pylist()]
    assert sets == [s.tobytes() for s in jaccard.shingle_sets(pa.array(texts[2:]))]


def test_bayesian_bound():
    least = jaccard.least_matches()
    assert all(0 < least[n] < 0.8 * n for n in least)
    assert least[240] / 240 > least[30] / 30  # more evidence, a tighter bound


def test_language(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.queries()["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.98


def test_code_lengths_are_exact():
    training = {"a": [b"banana bandana", b"a cabana"], "b": [b"xyzzy plugh xyzzy", b"xylem"]}
    counts = {}
    for lang, texts in training.items():
        runs = np.concatenate([langid.runs(c.data, c.at)[:-1] for t in texts for c in chunks(pa.array([t.decode()]))])
        values, n = np.unique(runs, return_counts=True)
        counts[lang] = (values, n)
    model = langid.Model(counts)
    texts = ["banana", "xyzzy band", "q", "é plugh", "a cab", ""]
    for chunk in chunks(pa.array(texts)):
        bits = model.code_lengths(chunk)
    for i, text in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert bits[i, j] == pytest.approx(brute.ppm_bits(text.encode(), training[lang]))


def test_archive(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.queries()["op10_warc_archive"](spark, sf).collect()}
    largest = {}
    for p in pages:
        largest[p.html or ""] = max(largest.get(p.html or "", -1), p.page_id)
    for p in pages:
        r, data = got[p.page_id], (p.html or "").encode()
        keeper = largest[p.html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == p.page_id else ("revisit", keeper))


def test_pipeline(spark, sf, docs):
    """Each stage against brute force on what the stage before it kept."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept, now = [], frame
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        kept.append(now.collect())
        if len(kept) < 5:
            assert now.columns == frame.columns
            now = spark.createDataFrame(kept[-1], frame.schema)
    source = {r.doc_id: r.source for r in frame.collect()}
    score = brute.likelihood_scores(docs, {d for d, q in labels.items() if q == 1})
    ok = {d for d, t in docs if not brute.quality_base(t)[5]}
    bins = Counter((round(score[d], 3), labels[d]) for d in ok if d in labels)
    cut = quality.best_cut([(s, bins[s, 1], bins[s, 0]) for s in {s for s, _ in bins}])
    stage = [(d, t) for d, t in docs if d in ok and score[d] >= cut]
    assert sorted(r.doc_id for r in kept[0]) == sorted(d for d, _ in stage)
    heads = {c for c, _ in brute.near_duplicates(stage).values()}
    stage = [(d, t) for d, t in stage if d in heads]
    assert sorted(r.doc_id for r in kept[1]) == sorted(d for d, _ in stage)
    dirty = brute.decontaminate(stage, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    stage = [(d, t) for d, t in stage if not dirty[d][4]]
    assert sorted(r.doc_id for r in kept[2]) == sorted(d for d, _ in stage)
    size = {d: len(brute.SPACED.findall(t or "")) for d, t in stage}
    copies, sizes, taken = Counter(r.doc_id for r in kept[3]), Counter(), Counter()
    for d, _ in stage:
        sizes[source[d]] += size[d]
        taken[source[d]] += copies[d] * size[d]
        assert copies[d] <= 2
    for s, want in brute.targets(sizes).items():
        assert abs(taken[s] - want) <= max(size[d] for d, _ in stage if source[d] == s) / 2 + 1e-6
    assert sorted(r.doc_id for r in kept[4]) == sorted(r.doc_id for r in kept[3])
    counts = Counter(r.shard for r in kept[4])
    assert max(counts.values()) - min(counts.values()) <= 1
    assert len({(r.shard, r.slot) for r in kept[4]}) == len(kept[4])
