"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chunk_dedup, components, decontamination, jaccard, langid, mixing, pii, quality, sharding, substring_dedup, warc
from quire.llm.shared import without
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "one line of quite ordinary words that stands in more than one document"
LONG = "\n".join(f"{LINE} number {i} of a very long text" for i in range(6000))
ROWS = [
    (1, f"{LINE}\nand a second line of six words here", "en", "a", 1),
    (2, f"{LINE}\nbut another second line with other words", "en", "a", 1),
    (2, f"{LINE}\nbut another second line with other words", "en", "a", 1),  # the same row again
    (2, "the same id with quite another text altogether", "en", "b", 1),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, "   \n\t ", "de", None, 5),
    (6, LONG, "en", "c", 1),
    (None, f"{LINE}\na line of a row without an id", "en", "a", 1),
    (None, None, None, None, None),
    (7, "😀 ümlaut ß ﬁ \x00 İ", "de", "😀", 1),
]
#: Names that the operators use for themselves.
CLASHES = (
    "tkey", "_id", "_key", "_hash", "_copies", "_copy", "_tkey", "node", "digest", "size", "shard", "slot", "label", "key", "n", "_s", "_t",
    "_gone_id", "_gone_key", "score", "row", "curve"
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (4, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, LINE), (2, "words that"), (3, None), (4, ""), (None, "second line with other words"), (5, LINE)], "item_id long, text string"
    )


def test_substring_dedup(odd, none):
    rows = substring_dedup.drop_repeated_units(odd).collect()
    assert len(rows) == len(ROWS)
    kept = {(r.doc_id, r.removed): r for r in rows}
    assert kept[1, ""].n_removed == 0
    assert [r.removed for r in rows if r.doc_id == 2 and r.n_removed] == [f"0:{len(LINE)}:1:0"] * 2
    assert next(r for r in rows if r.doc_id is None and r.text).text == "a line of a row without an id"
    assert next(r for r in rows if r.doc_id == 6).text == LONG
    assert next(r for r in rows if r.doc_id == 3).text is None
    assert substring_dedup.drop_repeated_units(none).collect() == []


def test_personal_data(spark, none):
    texts = [
        "a.b+c@d.ef.gh_x@y.z 1.2.3.4.5 256.1.1.1 001.02.3.4 +1 (743) 555-3824) +12 +1234567 4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890",
        "x" * 3_000 + "@" + "y.z" * 10 + "1" * 3_000 + " +" + "1" * 3_000,
        "1" + " 1" * 100_000, "@@@ a@b a@b. a@.b a@b..c +1() " * 50, "é😀 me@x.org ünd", None, "",
        "call 555-123-4567 or (555) 123-4567, mail me (at) host (dot) com",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("x")).withColumn("cands", F.lit(1))
    for r in pii.digest(pii.find(docs)).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert not want or set(want.split(",")) <= set(r.spans.split(","))
    assert pii.find(none).collect() == []


def test_personal_data_learns_from_votes(spark):
    """Looser candidates are added where the labelers agree, and not where they are told apart by their context."""
    exact = [(i, f"call my phone +1 (555) 123-{1000 + i} today") for i in range(200)]
    loose = [(1000, "call my phone (555) 123-4567 today"), (1001, "see version 555.123.4567x")]
    found = pii.find(spark.createDataFrame(exact + loose, "doc_id long, text string"))
    added = {r.doc_id: len(r.added) for r in found.collect()}
    assert added[1000] == 1 and added[1001] == 0
    masked = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(exact[:1], "doc_id long, text string"), found).collect()}
    assert "555" not in masked[0] and masked[0].startswith("call my phone █")


PLANTED = {
    "email": ["ann.lee (at) mail-host.org", "bob [at] post [dot] com", "c_d at server dot net", "eve+x {at} a.example {dot} de", "joe @ host . io"],
    "ip": ["10[.]0[.]3[.]44", "192(.)168(.)7(.)9", "172 dot 16 dot 4 dot 200", "127[.]0.0.1", "10[.]11.12[.]13"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "4012_8888_8888_1881", "4111  1111  1111  1111", "4111 - 1111 - 1111 - 1111"],
    "phone": ["(555) 234-4567", "555.234.7788", "0049 30 1234567", "030/1234567", "555 987 6543"],
}
DECOYS = {
    "email": ["look at noon dot dash", "meet @ five . sharp", "run at speed dot maximum"],
    "ip": ["version 3[.]0[.]999[.]4", "section 1 dot 400 dot 3 dot 512"],
    "card": ["order 4111.1111.1111.1112", "serial 9234_5678_9012_3456", "invoice 1000/2000/3000/4001"],
    "phone": ["isbn 111-222-3333", "order 011-011-0110", "page 000 111 2222"],
}
CUED = {"email": "my email is", "ip": "the server address", "card": "paid with card", "phone": "my phone:"}


def test_added_personal_data(spark):
    """Precision and recall of what the method adds, on planted spans that no exact pattern finds, among exact ones."""
    exact = {"email": "a{}@host.org", "ip": "10.0.0.{}", "card": "4111 1111 1111 1111", "phone": "+1 (555) 234-{}"}
    rows, want = [], {}
    for n in range(40):
        for kind, form in exact.items():
            rows.append(f"{CUED[kind]} {form.format(1000 + n if kind == 'phone' else n)} as said")
    for kind in pii.KINDS:
        for span in PLANTED[kind]:
            for before in (f"{CUED[kind]} ", "so it goes: "):
                want[len(rows)] = (kind, len(before), len(before) + len(span))
                rows.append(f"{before}{span} and more")
        rows += [f"he said {d} and left" for d in DECOYS[kind]]
        rows += ["ipsum dolor tell me of the ipsum", "the hostage was tallied, cellar by cellar"]
    found = pii.digest(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()
    added = {(r.doc_id, s) for r in found for s in set(r.spans.split(",")) - {f"{k}:{a}:{b}" for k, a, b in brute.pii(rows[r.doc_id])} - {""}}
    true = {(d, f"{k}:{a}:{b}") for d, (k, a, b) in want.items()}
    for kind in pii.KINDS:
        got, hoped = {x for x in added if x[1].startswith(kind)}, {x for x in true if x[1].startswith(kind)}
        assert len(got & hoped) >= 0.9 * len(hoped), (kind, "recall", hoped - got, [rows[d] for d, _ in hoped - got])
        assert len(got & hoped) >= 0.9 * len(got), (kind, "precision", [(rows[d], s) for d, s in got - hoped])


def test_cues_are_whole_words():
    import re

    words = {k: re.compile(r"(?<![^\W_])(?:%s)(?![^\W_])" % c) for k, c in pii.CUES.items()}
    assert not any(w.search("ipsum tell hostage cellar callow mailbox scorecard") for w in words.values())
    assert words["ip"].search("the ip is") and words["phone"].search("tel. me")


def test_masked_rows(spark):
    rows = [(1, "a@b.org x", "k"), (1, "a@b.org x", "k"), (None, "call +1 555 123 4567", "m"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string").withColumnRenamed("doc_id", "id")
    got = sorted(str((r.id, r.text, r.base)) for r in pii.masked(docs, mark="#", id_col="id").collect())
    assert got == sorted(["(1, '####### x', 'k')", "(1, '####### x', 'k')", "(None, 'call ###############', 'm')", "(2, None, None)"])


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ROWS)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert 0 <= r.taken <= 2 * r.size
    want = brute.targets(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in rows)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and {r._hash for r in out.collect()} == {"x"}
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string").withColumn("source", F.lit("a"))
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]


def test_chunk_dedup(odd, none):
    rows = chunk_dedup.drop_repeated_chunks(odd).collect()
    assert len(rows) == len(ROWS)
    assert next(r for r in rows if r.doc_id == 6).text == LONG
    assert chunk_dedup.drop_repeated_chunks(none).collect() == []


def test_decontamination(odd, none, bench):
    rows = decontamination.report(odd, bench).collect()
    want = brute.decontaminate([(i, t[1]) for i, t in enumerate(ROWS)], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(map(str, want.values())) == sorted(str((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in rows)
    blocks = decontamination.report(odd, bench, block_size=1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, blocks))
    assert decontamination.report(none, bench).collect() == []
    assert not any(r.n_hit for r in decontamination.report(odd, bench.limit(0)).collect())
    assert decontamination.drop_contaminated(odd, bench).columns == odd.columns


def test_quality(odd, none, labels):
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert len(quality.judge(odd, labels.limit(0)).where("kept or base_failed").collect()) == len(ROWS)
    assert quality.judge(none, labels).collect() == []
    want = sorted(str(brute.quality_base(t[1])) for t in ROWS)
    assert want == sorted(str((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)


def test_sharding(odd, none):
    rows = sharding.shard(odd, 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s in range(4) for i in range(sum(r.shard == s for r in rows)))
    assert next(r for r in rows if r.doc_id == 3).size == 1
    assert sharding.shard(none).collect() == []


def test_near_duplicates(odd, none, spark):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    twice = [r for r in rows if r.doc_id == 2 and r.n_copies == 2]
    assert len(twice) == 2 and all(r.n_links == 1 for r in twice)
    assert all(r.n_links == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert jaccard.near_duplicates(none).collect() == []
    short = spark.createDataFrame([(1, "a b"), (2, "A, b!"), (3, "a"), (4, "b a")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in jaccard.near_duplicates(short).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "2", "3", "4", "5", "6", "None", "None", "7"])


def test_language(odd, none):
    labelled = odd.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = langid.predict(odd, langid.train(labelled)).collect()
    assert len(rows) == len(ROWS)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert next(r for r in rows if r.doc_id == 6).lang_pred == "en"
    assert langid.predict(none, langid.train(labelled)).collect() == []
    assert {r.lang_pred for r in langid.predict(odd, langid.train(labelled.limit(0))).collect()} == {"und"}


def test_archive(spark, tmp_path):
    rows = [
        (1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "a\r\nb: c", None), (4, "v", ""), (4, "v", ""), (5, "w", "x\r\n\r\nWARC/1.1\r\n"),
        (5, "w", "other"), (None, "z", "<p>é</p>")
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("x")).withColumn("payload", F.lit("y"))
    warc.write_archive(pages, f"{tmp_path}/a")
    back = warc.read_records(spark, f"{tmp_path}/a")
    got = warc.parse_records(back).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [
            ("1", "revisit", "2"), ("2", "response", "None"), ("3", "revisit", "4"), ("4", "response", "None"), ("4", "response", "None"),
            ("5", "response", "None"), ("5", "response", "None"), ("None", "revisit", "2")
        ]
    )
    assert all(r.declared_digest == f"sha1:{r.payload_digest}" for r in got)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 4
    record = next(
        bytes(r.record) for r in warc.record_bytes(
            back.where("decode(header, 'utf-8') like '%page:2>%response%' or decode(header, 'utf-8') like '%response%page:2>%'")
        ).collect()
    )
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith("\r\n\r\n<p>é</p>\r\n\r\n".encode())
    warc.write_archive(pages, f"{tmp_path}/b", least=5)
    few = warc.parse_records(warc.read_records(spark, f"{tmp_path}/b")).collect()
    assert {r.record_type for r in few if r.payload_bytes < 5} == {"response"} and any(r.record_type == "revisit" for r in few)
    warc.write_archive(pages.limit(0), f"{tmp_path}/c")
    assert warc.read_records(spark, f"{tmp_path}/c").count() == 0


def test_damaged_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{tmp_path}/b/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, f"{tmp_path}/b").collect()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 102: 100, 200: 200}
    assert components.connected(spark.createDataFrame([], "u long, v long")).collect() == []


def test_without(odd, spark):
    keys = odd.where("doc_id = 1").selectExpr("doc_id", "xxhash64(text, isnull(text)) as tkey")
    assert without(odd, keys).count() == len(ROWS) - 1
    assert without(odd, keys.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, odd, none, stage):
    last = stage is corpus_pipeline.STAGES[-1][1]
    out = stage(spark, odd, sf)
    out.collect()
    empty = stage(spark, none, sf)
    assert empty.collect() == []
    if not last:
        assert out.columns == odd.columns and empty.columns == none.columns
