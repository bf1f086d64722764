"""The whole dataflow over generated books, and the rules one by one."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.catalog import QUERIES
from quire.cli import main
from quire.functions import vocab as V
from quire.operators import audit, chunking, families, model, profiles, review, rules, signals, units
from quire.operators.chunking import Policy, SimpleTokenizer, chunk_coverage, cut, widen
from quire.operators.search import find_text
from quire.plans.corpus import Corpus, Options
from quire.streaming.ingest import ingest
from tests.books import PROSE, chapter, epub, harbour, page


def corpus(spark, *contents: bytes, **options) -> Corpus:
    files = spark.createDataFrame([(f"b{i}.epub", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    return Corpus.from_files(files, Options(**options))


@pytest.fixture(scope="module")
def book(spark):
    return corpus(spark, harbour())


def by_name(rows):
    return {r["href"].rsplit("/", 1)[-1]: r for r in rows}


def test_document_roles(book):
    roles = {k: r["role"] for k, r in by_name(book.verdicts.collect()).items()}
    assert {k: roles[k] for k in ("c1.xhtml", "notes.xhtml", "works.xhtml")} == {"c1.xhtml": V.BODY, "notes.xhtml": V.NOTE, "works.xhtml": V.BIBLIOGRAPHY}


def test_block_categories(book):
    found = {}
    for r in book.blocks().collect():
        found.setdefault(r["href"].rsplit("/", 1)[-1], set()).add((r["category"], r["classification_rule"]))
    assert found["title.xhtml"] == {("paratext", "exact-book-title-page")}
    assert {c for c, _ in found["c3.xhtml"]} == {"work_text"}
    assert {c for c, _ in found["notes.xhtml"]} == {"note"}
    assert {c for c, _ in found["works.xhtml"]} == {"bibliography"}
    assert found["rights.xhtml"] == {("paratext", "marginal-legal-matter")}


def test_metadata(book):
    r = book.metadata().first()
    assert r["authors"] == ["Jane Doe"] and r["publication_date"] == "2019-05-02"


def test_coverage_adds_up(book):
    r = book.coverage.first()
    assert r["valid"] and r["main"] + r["notes"] + r["excluded"] == r["classified"]
    assert r["classified"] == sum(len(u["text"]) for u in book.units("all").collect())
    assert not book.rejected.count()


def test_text_and_categories(book):
    text = book.text().first()["text"]
    assert "Chapter 1" in text and "ISBN" not in text and "short remark" not in text
    assert "short remark" in book.text(("note",)).first()["text"]
    with pytest.raises(ValueError, match="unknown"):
        book.units(("novel",))
    with pytest.raises(ValueError, match="collection"):
        book.units("note")


def test_sequences_do_not_cross_categories(book):
    units_ = {u["unit_id"]: u for u in book.units("all").collect()}
    for s in book.sequences("all").collect():
        assert {units_[u["unit_id"]]["category"] for u in s["units"]} == {s["category"]}
        assert all(s["text"][u["start"] : u["stop"]] == u["text"] for u in s["units"])


def test_search_and_anchors(book):
    hits = book.find_text("did not come back", "SHIP THAT").collect()
    assert {h["query"] for h in hits} == {"SHIP THAT"}
    text = "".join(s["text"] for s in book.sequences().collect())
    assert len(hits) == text.lower().count("ship that")
    assert all(h["text"].lower() == "ship that" for h in hits)
    checked = book.verify_sources(book.find_text("ship that").select("anchor")).collect()
    assert checked and all(r["verified"] for r in checked)
    exact = book.find_text("SHIP", case_sensitive=True)
    assert exact.count() == 0
    with pytest.raises(ValueError, match="empty"):
        book.find_text("")


def test_damaged_anchors_do_not_verify(book):
    one = book.find_text("ship that").limit(1).select("anchor")
    wrong = one.withColumn("anchor", F.col("anchor").withField("text_fingerprint", F.lit("0")))
    other = one.withColumn("anchor", F.col("anchor").withField("epub_sha256", F.lit("0")))
    assert [r["verified"] for r in book.verify_sources(wrong.unionByName(other)).collect()] == [False, False]


def test_search_literals(spark):
    unit = "array(named_struct('unit_id','u','start',0,'stop',length(text),'text',text,'title',cast(null as string),'confidence',1.0D,'source','s','evidence',array('e'),'fragments',array(named_struct('xpath','/p','start',0,'stop',length(text),'fingerprint','f','source_start',0))))"
    s = spark.createDataFrame([("aXbXXa.b[\\E]x", "1")], "text string, sequence_id string").selectExpr(
        "'b' as book_id", "sequence_id", "'h' as href", "'work_text' as category", "'main' as use", "text", f"{unit} as units"
    )
    q = spark.createDataFrame([("x",), ("a.b",), ("[\\E]",), ("xx",)], "query string")
    assert sorted((r["query"], r["start"]) for r in find_text(s, q).collect()) == [("[\\E]", 8), ("a.b", 5), ("x", 1), ("x", 3), ("x", 4), ("x", 12), ("xx", 3)]


def test_chunks(book):
    policy = Policy(60, 20, 10, 120)
    cuts = book.chunks("all", policy)
    rows = cuts.collect()
    sequences = {s["sequence_id"]: s for s in book.sequences("all").collect()}
    for r in rows:
        assert r["tokens"] <= 60 and r["text"] == sequences[r["sequence_id"]]["text"][r["start"] : r["stop"]]
    cover = chunk_coverage(book.sequences("all"), cuts).first()
    assert cover["gap"] == 0 and cover["chunks"] == len(rows)
    wide = book.contexts(cuts, "all", policy).collect()
    assert len(wide) == len(rows) and all(r["tokens"] <= 120 for r in wide)
    assert all(r["verified"] for r in book.verify_sources(cuts.select("anchor")).collect())


def test_cut_prefers_the_end_of_an_element():
    text = " ".join(f"w{i}" for i in range(30))
    end = text.index(" w8")
    assert cut(text, [end], Policy(10, 5, 2, 10), SimpleTokenizer())[0] == (0, end, 8)
    assert cut(text, [], Policy(10, 5, 2, 10), SimpleTokenizer())[0][2] == 10
    assert cut("  ", [], Policy(10, 5, 2, 10), SimpleTokenizer()) == []
    assert widen(text, 0, 2, 5, SimpleTokenizer())[2] == 5


def test_bad_tokenizer():
    class Wrong(SimpleTokenizer):
        def spans(self, text):
            return [(0, 3), (2, 4)]

    with pytest.raises(ValueError, match="overlaps"):
        cut("abcdef", [], Policy(), Wrong())
    with pytest.raises(ValueError, match="overlap_tokens"):
        Policy(10, 5, 10, 20)


def test_records(book):
    r = book.rag_records(max_tokens=50, min_tokens=10, overlap_tokens=5).orderBy("first_order", "chunk").first()
    meta = r["metadata"]
    assert meta["category"] == "work_text" and meta["book"]["authors"] == ["Jane Doe"] and meta["source"]["href"].endswith("c1.xhtml")


def test_duplicate_reading_order_is_refused(spark):
    twice = corpus(spark, epub({"a.xhtml": chapter(1)}, spine=["a.xhtml", "a.xhtml"]), epub({"b.xhtml": chapter(2)}))
    assert [r["reason"] for r in twice.rejected.collect()] == ["coverage validation failed"]
    assert twice.metadata().count() == 1


def test_unreadable_books_are_rows(spark):
    c = corpus(spark, b"junk", harbour())
    assert c.rejected.count() == 1 and c.metadata().count() == 1


def profile(of, **fields) -> dict:
    sha = of.books.first()["book_id"]
    return {
        "schema": profiles.SCHEMA, "created_at": "t", "version": "1", "category_policy_version": 1,
        "book": {"sha256": sha, "path": "", "title": "", "language": ""}, "documents": [], "blocks": [], "ranges": [], "ignored_annotations": []
    } | fields


def corrected(spark, tmp_path, *payloads: dict) -> Corpus:
    for i, p in enumerate(payloads):
        (tmp_path / f"{i}.json").write_text(json.dumps(p))
    return corpus(spark, harbour(), profiles=profiles.load_profiles(spark, str(tmp_path)))


def test_profile_precedence_and_ranges(spark, book, tmp_path):
    block = next(b for b in book.blocks().collect() if b["href"].endswith("c1.xhtml"))
    text = block["text"]
    selected = " ".join(text[10:40].split()).casefold()
    import hashlib

    p = profile(
        book,
        documents=[{"href": block["href"], "category": "note", "note": "", "updated_at": ""}],
        blocks=[{
            "block_id": block["block_id"], "href": block["href"], "xpath": block["xpath"], "fingerprint": block["fingerprint"], "category": "index",
            "note": "", "updated_at": ""
        }],
        ranges=[{
            "range_id": "r", "block_id": block["block_id"], "href": block["href"], "xpath": block["xpath"], "block_fingerprint": block["fingerprint"],
            "start": 10, "end": 40, "text_fingerprint": hashlib.sha256(selected.encode()).hexdigest()[:20], "category": "bibliography", "note": "",
            "updated_at": ""
        }],
    )
    c = corrected(spark, tmp_path, p)
    assert not c.rejected_profiles.count()
    mine = [r for r in c.units("all").orderBy("order").collect() if r["block_id"] == block["block_id"]]
    assert [r["category"] for r in mine] == ["index", "bibliography", "index"]
    assert "".join(r["text"] for r in mine) == text
    assert mine[1]["source"] == "edition_profile_range" and mine[0]["confidence"] == 1.0
    assert c.coverage.first()["valid"]
    assert all(r["verified"] for r in c.verify_sources(c.units("all").select("anchor")).collect())


def test_profiles_are_rejected_as_a_whole(spark, book, tmp_path):
    good = {"href": "OEBPS/c1.xhtml", "category": "note", "note": "", "updated_at": ""}
    over = {
        "range_id": "r", "block_id": "b", "href": "h", "xpath": "x", "block_fingerprint": "f", "start": 0, "end": 5, "text_fingerprint": "t",
        "category": "note", "note": "", "updated_at": ""
    }
    c = corrected(
        spark, tmp_path,
        profile(book, documents=[good, good]),
        profile(book, documents=[good, good | {"href": "missing"}]),
        profile(book, category_policy_version=2),
        profile(book, book={"sha256": "0" * 64}),
        profile(book, ranges=[over, over | {"range_id": "s", "start": 3, "end": 9}]),
        profile(book, documents=[good | {"category": "novel"}]),
    )
    reasons = {r["reason"] for r in c.rejected_profiles.collect()}
    for part in ("duplicate document", "document not found", "policy version", "no such file", "overlapping range", "unsupported category"):
        assert any(part in r for r in reasons), part
    assert c.rejected_profiles.select("profile").distinct().count() == 6
    assert not c.units("all").where("source like 'edition%'").count()


class Reviewer:
    """Suggests a change for the first block of each request."""

    def __init__(self):
        self.model = "fake"

    def request_structured(self, input_data, system_prompt, schema, prompt_version):
        from quire.sources.backend import Answer

        findings = []
        for b in input_data.get("blocks", [])[:1]:
            base = {
                "kind": "category_change", "scope": "block", "href": b["href"], "block_id": b["block_id"], "proposed_category": "paratext",
                "severity": "info", "confidence": 0.5, "explanation": "x", "evidence": ["y"]
            }
            findings += [base, base | {"block_id": "none"}, base | {"proposed_category": b["deterministic_category"]}, base | {"severity": "odd"}]
        return Answer({"findings": findings}, "fake", network_attempts=1)


def test_audit(spark, book):
    before = {r["block_id"]: r["category"] for r in book.blocks().collect()}
    r = book.audit(Reviewer()).first()
    assert r["complete"] and r["models"] == ["fake"]
    assert {f["proposed_category"] for f in r["findings"]} == {"paratext"}
    assert {i["reason"] for i in r["issues"]} >= {"no such block", "a category change must change the category", "invalid severity"}
    assert before == {r["block_id"]: r["category"] for r in book.blocks().collect()}
    plan = book.audit_requests()
    sums = audit.estimate(plan, book.classified).first()
    assert sums["total_calls"] == plan.count() == r["calls"] and sums["blocks"] == len(before)
    sent = [b["block_id"] for x in plan.where("pass = 'complete_block_review'").collect() for b in json.loads(x["input"])["blocks"]]
    assert sorted(sent) == sorted(before)


def test_answers_are_kept_in_a_table(spark, book, tmp_path):
    """A second audit asks nothing, whatever executor it runs on; another backend's answers are others."""
    plan, store = book.audit_requests(), str(tmp_path / "answers")
    first = audit.answer(plan, Reviewer(), store=store).collect()
    again = audit.answer(plan, Reviewer(), store=store).collect()
    key = lambda r: (r.book_id, r.name, r.call)
    assert len(first) == plan.count() == len(again) and not any(r.cached for r in first) and all(r.cached for r in again)
    assert {key(r): r.data for r in first} == {key(r): r.data for r in again}
    assert spark.read.parquet(store).count() == len(first)

    class Other(Reviewer):
        pass

    assert not any(r.cached for r in audit.answer(plan, Other(), store=store).collect())


def test_package_and_chunk_plan(spark, book, tmp_path):
    book.write(str(tmp_path / "out"), policy=Policy(120, 20, 10, 240))
    units_back = spark.read.json(str(tmp_path / "out" / "units")).collect()
    assert len(units_back) == book.units("all").count() and all(r.text for r in units_back)
    plan = spark.read.json(str(tmp_path / "out" / "chunks")).collect()
    cut_ = book.chunks("all", Policy(120, 20, 10, 240)).collect()
    assert {r.id for r in plan} == {r.chunk_id for r in cut_} and "text" not in plan[0]
    assert {(r.policy.max_tokens, r.schema) for r in plan} == {(120, "quire-chunk-plan-1")}
    book.write(str(tmp_path / "bare"), with_text=False)
    assert "text" not in spark.read.json(str(tmp_path / "bare" / "units")).columns


def test_sequences_are_written_once(book):
    one = book.sequences(("note", "work_text"))
    assert book.sequences(["work_text", "note"]) is one and book.sequences("all") is not one


def test_a_failed_signal_leaves_the_others(spark, book):
    named = signals.voters(book.books, book.documents_raw, book.blocks_raw)
    broken = named | {"graph": lambda: book.documents_raw.select(F.raise_error(F.lit("no graph")).alias("book_id"))}
    votes, faults = signals.all_votes(broken)
    assert set(faults) == {"graph"} and "no graph" in faults["graph"]
    assert {r.signal for r in votes.select("signal").distinct().collect()} <= {"declarations", "title", "shape", "position"}
    assert votes.count() and not book.failed_signals
    with pytest.raises(RuntimeError, match="no signal"):
        signals.all_votes({"graph": broken["graph"]})


def test_audit_progress(spark, book):
    plan = book.audit_requests()
    answers = audit.answer(plan, Reviewer())
    state = lambda a: [(r.planned, r.answered, r.state) for r in audit.progress(plan, a).collect()]
    n = plan.count()
    assert state(answers) == [(n, n, "complete")]
    assert state(answers.limit(1)) == [(n, 1, "running")] and state(answers.limit(0)) == [(n, 0, "planned")]


def test_review_session(spark, tmp_path):
    session = review.Session(spark, str(tmp_path / "review"))
    assert session.annotations().count() == 0 and session.decisions().count() == 0
    row = lambda label, at, deleted=False, range_id=None, start=None, end=None: (
        "b", "range" if range_id else "block", label, "h", "k", "/p", "f", range_id, start, end, None, "", at, deleted
    )
    put = lambda *rows: session.annotate(spark.createDataFrame(list(rows), review.ANNOTATION))
    put(row("note", "2024-01-01"), row("index", "2024-01-01", range_id="r1", start=0, end=10))
    put(row("paratext", "2024-01-02"))
    with pytest.raises(ValueError, match="overlapping ranges: b#h#k#r2"):
        put(row("index", "2024-01-03", range_id="r2", start=5, end=12))
    assert {(r.scope, r.label) for r in session.annotations().collect()} == {("block", "paratext"), ("range", "index")}
    put(row("index", "2024-01-04", deleted=True, range_id="r1", start=0, end=10))
    put(row("index", "2024-01-05", range_id="r2", start=5, end=12))
    assert {(r.label, r.range_id) for r in session.annotations().collect()} == {("paratext", None), ("index", "r2")}
    session.decide(spark.createDataFrame(
        [
            ("b", "f1", "accepted", "note", "", "2024-01-06", False), ("b", "f2", "accepted", "note", "", "2024-01-06", False),
            ("b", "f2", "accepted", "note", "", "2024-01-07", True)
        ],
        review.DECISION
    ))
    assert [r.finding_id for r in session.decisions().collect()] == ["f1"]
    fields = "book_id string, finding_id string, scope string, href string, block_id string, xpath string, fingerprint string, explanation string, proposed_category string, can_override boolean, run string"
    findings = spark.createDataFrame([("b", f, "block", "h", k, "/p", "f", "why", "note", True, "2024-01-05") for f, k in (("f1", "k9"), ("f2", "k8"))], fields)
    assert {(r.block_id, r.label) for r in session.export(findings).collect()} == {("k", "paratext"), ("k", "index"), ("k9", "note")}


def test_audit_can_be_stopped(book):
    plan = book.audit_requests()
    seen = []
    with pytest.raises(audit.Cancelled):
        audit.audit_one(plan, Reviewer(), progress=lambda i, n, kind: seen.append(i), cancelled=lambda: len(seen) >= 2)
    assert seen == [1, 2]
    with pytest.raises(ValueError, match="blocks_per_batch"):
        audit.Config(blocks_per_batch=0)


def test_families(spark):
    rows = [
        ("a", [f"t{i}" for i in range(10)], "1"), ("b", [f"t{i}" for i in range(10)] + ["u"], "0"), ("c", [f"v{i}" for i in range(10)], "2"),
        ("d", [], "3")
    ]
    books = spark.createDataFrame(rows, "book_id string, template array<string>, template_id string")
    assert {r["book_id"]: r["family"] for r in families.families(books).collect()} == {"a": "fam-0", "b": "fam-0", "c": "fam-2"}


def test_model(spark, book, tmp_path):
    keys = ["book_id", "href", "spine_index", "block_index"]
    facts = rules.context(book.books, book.verdicts, book.blocks_raw).join(
        book.verdicts.select("book_id", "href", "spine_index", "votes", "linear"), ["book_id", "href", "spine_index"]
    )
    examples = model.features(facts).select(
        *keys, "features", F.when(F.col("d_role") == V.BODY, V.BODY).otherwise(V.PARATEXT).alias("role"), F.lit(1.0).alias("weight")
    )
    weights = model.train(examples)
    model.save(weights, str(tmp_path / "m.json"), 1.5)
    again, temperature = model.load(spark, str(tmp_path / "m.json"))
    assert temperature == 1.5 and again.count() == weights.count()
    assert 0.5 <= model.calibrate(examples, weights, keys) <= 3.0
    scored = model.score(examples.drop("role"), weights, keys).join(examples.select(*keys, "role"), keys).collect()
    assert sum(r["m_role"] == r["role"] for r in scored) / len(scored) > 0.9
    c = corpus(spark, harbour(), weights=weights)
    assert c.blocks().where("classification_rule = 'linear-model'").count()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "b.epub").write_bytes(harbour())
    assert main([str(tmp_path / "b.epub"), "-o", str(tmp_path / "out.txt")], spark) == 0
    assert "Chapter 1" in (tmp_path / "out.txt").read_text()
    assert main([str(tmp_path), "--format", "rag-jsonl", "--category", "all"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["metadata"]["schema"]
    assert main([str(tmp_path), "--format", "units-json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["units"]
    (tmp_path / "c.epub").write_bytes(b"junk")
    assert main([str(tmp_path)], spark) == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(harbour())
    run = lambda: ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    run()
    first = spark.read.parquet(f"{tmp_path}/out/units").count()
    (tmp_path / "in" / "b.epub").write_bytes(epub({"x.xhtml": chapter(9)}))
    run()
    units_ = spark.read.parquet(f"{tmp_path}/out/units")
    assert first and units_.select("book_id").distinct().count() == 2


def rule_of(spark, documents: dict[str, str], **more) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in corpus(spark, epub(documents, **more)).classified.orderBy("spine_index", "block_index").collect():
        out.setdefault(r["href"].rsplit("/", 1)[-1], []).append(r["rule_id"])
    return out


def test_local_rules(spark):
    docs = {f"c{i}.xhtml": chapter(i) for i in range(1, 6)}
    docs["c2.xhtml"] = page(
        f'<h1>Chapter 2</h1><p>{PROSE * 3}</p><aside epub:type="footnote"><p>A note.</p></aside><div class="footnotes"><p>Another.</p></div><p class="caption">A quay in the morning light.</p>'
    )
    docs["c3.xhtml"] = page(f'<h1>Chapter 3</h1><p>{PROSE}</p><p>Fa parte della raccolta.</p><p class="titlepage1">Racconti</p>')
    docs["c4.xhtml"] = page('<p class="dedication">Dark was</p><p class="dedication extract signature">the night. A. Poet</p>' + f"<p>{PROSE * 8}</p>")
    found = rule_of(spark, docs)
    assert found["c2.xhtml"].count("local-semantic-declaration") == 1 and found["c2.xhtml"].count("local-structural-marker") == 1
    assert "editorial-collection-reference" in found["c3.xhtml"]


def test_overrides(spark):
    docs = {f"c{i}.xhtml": chapter(i) for i in range(1, 5)}
    c = corpus(spark, epub(docs), document_overrides={"c1.xhtml": V.NOTE})
    assert by_name(c.verdicts.collect())["c1.xhtml"]["evidence"] == ["corrected by hand"]
    block = c.classified.where("href like '%c2.xhtml'").first()
    d = corpus(spark, epub(docs), block_overrides={block["block_id"]: V.BIBLIOGRAPHY})
    assert d.classified.where(F.col("block_id") == block["block_id"]).first()["rule_id"] == "manual-override"


def test_block_packing(spark):
    long = page("".join(f"<p>{'x' * 4990} {i}</p>" for i in range(5)))
    sizes = [r["elements"] for r in corpus(spark, epub({"a.xhtml": long})).blocks_raw.orderBy("block_index").collect()]
    assert sizes == [2, 2, 1]


def test_rule_names_are_unique():
    assert len(rules.RULES) == len(set(rules.RULES)) == 32


def test_fragments_of_slices(spark):
    rows = spark.sql(
        "select array(named_struct('xpath','/a','start',0,'stop',5,'fingerprint','f','source_start',0), named_struct('xpath','/b','start',6,'stop',9,'fingerprint','g','source_start',0)) as f"
    )
    got = rows.select(units.slice_fragments(F.col("f"), F.lit(3), F.lit(8)).alias("x")).first()["x"]
    assert [(r["xpath"], r["start"], r["stop"], r["source_start"]) for r in got] == [("/a", 0, 2, 3), ("/b", 3, 5, 0)]


def test_contexts_take_a_text_apart_once():
    text, seen = "a b c d e f g h i j", []

    class Counted:
        name, exact = "counted", True

        def spans(self, t):
            seen.append(t)
            return SimpleTokenizer().spans(t)

    cuts_ = [(i, i + 3) for i in range(0, 16, 4)]
    assert chunking.widened(text, cuts_, 5, Counted()) == [widen(text, a, b, 5, SimpleTokenizer()) for a, b in cuts_]
    assert seen.count(text) == 1


def test_chunks_that_nobody_names_get_no_names(spark, sf):
    """Only a consumer of ids, texts or anchors pays for them."""
    plan = QUERIES["fixed_chunks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "cuts(" in plan and "epub_sha256" not in plan


def test_a_failed_signal_is_no_result(spark, book, monkeypatch, sf):
    def fail(documents):
        return documents.select(F.raise_error(F.lit("no title")).alias("book_id"))

    monkeypatch.setattr(signals, "titles", fail)
    with pytest.raises(RuntimeError, match="no title"):
        QUERIES["epub_votes"](spark, sf)
    with pytest.raises(RuntimeError, match="no title"):
        corpus(spark, harbour()).verdicts  # noqa: B018
    kept = corpus(spark, harbour(), without_failed_signals=True)
    assert kept.verdicts.count() and set(kept.failed_signals) == {"titles"}


def optimized(spark, sf, name: str) -> str:
    return QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_normalized_once(spark, sf):
    assert optimized(spark, sf, "lexical_flags").count("translate(") == 1


def test_votes_by_position_read_the_documents_once(spark, sf):
    assert optimized(spark, sf, "position_votes").count("Relation [") == 1


def test_similar_templates_lose_no_pair(spark):
    """Against brute force, over sets of all sizes that are cut from each other, with common and rare tokens."""
    draw = random.Random(5)
    common, sets = [f"c{i}" for i in range(30)], {}
    for i in range(240):
        old = sorted(sets.get(draw.randrange(i), ())) if i and draw.random() < 0.7 else []
        kept = [t for t in old if draw.random() < 0.9] + [t for t in common if draw.random() < 0.2]
        sets[i] = set(kept + [f"r{i}-{k}" for k in range(draw.randrange(1 + len(kept) // 6))]) or {"x"}
    books = spark.createDataFrame([(i, sorted(t)) for i, t in sets.items()], "book_id long, template array<string>")
    got = {(r.a, r.b): r.similarity for r in families.similar_templates(books).collect() if r.similarity < 1}
    share = lambda a, b: len(a & b) / len(a | b)
    first = [i for i in sets if all(sets[j] != sets[i] for j in range(i))]
    assert got == {(a, b): share(sets[a], sets[b]) for a in first for b in first if a < b and share(sets[a], sets[b]) >= 0.72} and got


def test_a_token_that_stands_alone_is_not_filed():
    counts = np.ones(families.BUCKETS, np.int32)
    counts[[1, 2, 3]] = 9, 2, 5
    assert families.prefix(np.array([1, 2, 3, 4]), counts, 0.5) == [None, 2, 3]


def test_sources_are_cut_once(book):
    """Anchors made by a tokenizer are written before they are looked up, and pieces without their unit's text."""
    cuts = book.chunks("all", Policy(60, 10, 10, 120))
    checked = book.verify_sources(cuts.select("anchor"))
    assert "cuts(" not in checked._jdf.queryExecution().optimizedPlan().toString() and all(r["verified"] for r in checked.collect())
