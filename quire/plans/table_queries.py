"""Queries that run the operators over the driver's tables, each with SQL for another engine in quire.plans.oracles."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.lexical import (
    backlist, category_of_role, contents_opening, editorial_credits, legal, lookup, promotion, short_dedication, title_role, use_of_category, user_licence,
)
from quire.operators import audit, chunking, families, links, model, profiles, review, search, segment, sequences, signals, units, verdicts
from quire.operators.rules import classify, context
from quire.plans import standins as S
from quire.plans.corpus import Corpus
from quire.sources.tables import durable

TITLES = (
    ("Note", "it"), ("Indice analitico", "it"), ("Il libro di larga circolazione", "it"), ("Prefazióne", "it"), ("Sources", "en"),
    ("Sources of the Nile", "en"), ("Table of Contents", "en"), ("Anhang", "de"), ("Ottocento", "it"),
    ("About the author", "fr"), ("Chapter 3", "es"), ("Notas al texto", "es"), ("References", "en"), ("Indice", "es"),
)


def shape_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = signals.shape_metrics(S.sections(spark, sf_dir))
    r = lambda c: F.round(c, 4).cast("decimal(18,4)").alias(c)
    return m.select("doc_id", "n_paragraphs", r("mean_chars"), r("years"), r("citations"), r("numbers"), r("short"), "progressive")


def shape_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.shapes(S.sections(spark, sf_dir)).select("href", "role", "weight")


def position_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.position(S.sections(spark, sf_dir)).select("href", "role", "weight", "confirms")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.sections(spark, sf_dir)
    votes = signals.titles(docs).unionByName(signals.shapes(docs)).unionByName(signals.position(docs))
    return verdicts.document_verdicts(docs, votes)


def doc_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select(
        "doc_id", "role", F.col("confidence").cast("decimal(6,3)").alias("confidence"), category_of_role("role").alias("category")
    )


def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each book by category, summed over its documents' coverage; a document is one unit here."""
    done = _verdicts(spark, sf_dir).withColumn("category", category_of_role("role")).withColumn("use", use_of_category("category"))
    each = units.document_coverage(S.sections(spark, sf_dir), done.select("book_id", "href", "category", "use", "text"))
    by = each.select("book_id", F.explode("by_category").alias("category", "c"))
    return by.groupBy("book_id", "category").agg(F.sum("c").alias("chars"), F.count("*").alias("documents")).withColumn("use", use_of_category("category"))


def title_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages").where("html is not null")
    heads = pages.select(
        T.heading("html")["text"].alias("title"), F.nullif(F.regexp_extract("html", '(?i)<html[^>]*lang="([a-z-]+)"', 1), F.lit("")).alias("language")
    ).where("title is not null")
    both = heads.unionByName(spark.createDataFrame(list(TITLES), "title string, language string")).distinct()
    said = both.withColumn("said", title_role("title", "language"))
    return said.select("title", "language", F.col("said.role").alias("role"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", T.normalized("text").alias("normalized"))


def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", T.fingerprint("text", 24).alias("fingerprint"), T.joined_id("source", "doc_id").alias("joined_id"))


def duplicate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(T.fingerprint("text", 24).alias("fingerprint")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")
    ).where("copies > 1")


def page_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages").where("html is not null")
    return pages.select("page_id", T.visible_text("html").alias("text"))


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages").where("html is not null")
    return pages.select("page_id", F.posexplode(T.paragraphs("html")).alias("pos", "paragraph"))


def page_toc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages").where("html is not null")
    each = pages.select("page_id", F.posexplode(T.toc_links("html")).alias("pos", "l"))
    return each.groupBy("page_id", F.col("l.href").alias("href")).agg(F.min_by("l.title", "pos").alias("title"))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages").where("html is not null").withColumn("h", T.heading("html"))
    return pages.where("h is not null").select("page_id", F.col("h.level").alias("level"), F.col("h.text").alias("heading"))


def href_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages").where("html is not null")
    base = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    each = pages.select(
        "page_id", base.alias("base"),
        F.explode(F.regexp_extract_all("html", F.lit("""(?i)<a\\b[^>]*href\\s*=\\s*["']([^"']+)["']"""), F.lit(1))).alias("href")
    )
    return each.select("page_id", "href", T.resolve("base", "href").alias("resolved"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sequences(S.language_units(spark, sf_dir), "all")


def hard_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sequences(spark, sf_dir)
    return s.select(
        "book_id", "sequence_id", "category", "use", F.size("units").alias("n_units"), F.length("text").alias("chars"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256")
    )


def filtered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for two of the categories: what is filtered out leaves gaps."""
    s = sequences.sequences(S.language_units(spark, sf_dir), ("work_text", "note"))
    return s.select("book_id", "sequence_id", "category", F.size("units").alias("n_units"), F.length("text").alias("chars"))


def sequence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("sequence_id", F.explode("units").alias("u")).select("sequence_id", "u.unit_id", "u.start", "u.stop")


ROLE_CATEGORY = {"user": "work_text", "assistant": "note", "system": "paratext", "tool": "bibliography"}


def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role: sequences of units, with the role as category."""
    turns = S.table(spark, sf_dir, "conversations").where("text is not null")
    empty = F.array().cast("array<string>")
    spots = F.array().cast("array<struct<xpath:string,start:int,stop:int,fingerprint:string,source_start:int>>")
    category = F.coalesce(lookup(ROLE_CATEGORY, F.col("role")), F.lit("index"))
    own = turns.select(
        F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("order"), F.col("turn").cast("string").alias("unit_id"),
        F.lit("c").alias("href"), "text", F.lit(None).cast("string").alias("title"),
        category.alias("category"), use_of_category(category).alias("use"), F.lit(1.0).alias("confidence"), F.lit("role").alias("source"),
        empty.alias("evidence"), spots.alias("fragments"),
    )
    runs = sequences.sequences(own, "all")
    role = lookup({c: r for r, c in ROLE_CATEGORY.items()}, F.col("category"))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("first_order"))
    chars = F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + F.length(u["text"]))
    return runs.select(
        F.col("book_id").cast("long").alias("conv_id"), number.alias("run"), role.alias("role"), F.size("units").alias("turns"),
        F.col("first_order").alias("first_turn"), chars.alias("chars")
    )


def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text in every document, without regard to case."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    fragment = F.array(F.struct(
        F.lit("/").alias("xpath"), F.lit(0).alias("start"), F.length("text").alias("stop"), F.lit("").alias("fingerprint"),
        F.lit(0).alias("source_start")
    ))
    unit = F.struct(
        F.lit("u").alias("unit_id"), F.lit(0).alias("start"), F.length("text").alias("stop"), "text", F.lit(None).cast("string").alias("title"),
        F.lit(1.0).alias("confidence"), F.lit("t").alias("source"), F.array().cast("array<string>").alias("evidence"), fragment.alias("fragments")
    )
    seqs = docs.select(
        F.lit("").alias("book_id"), F.col("doc_id").cast("string").alias("sequence_id"), F.lit("").alias("href"),
        F.lit("work_text").alias("category"), F.lit("main").alias("use"), "text", F.array(unit).alias("units")
    )
    hits = search.find_text(seqs, S.table(spark, sf_dir, "benchmark").select(F.col("text").alias("query")))
    return hits.select("query", F.col("sequence_id").cast("long").alias("doc_id"), "start", "stop", "text")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    own = chunking.SimpleTokenizer()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(own.spans(t)))

    return docs.select("doc_id", count("text").alias("tokens"))


def _chunked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _sequences(spark, sf_dir)
    bare = s.withColumn("stops", F.array().cast("array<int>"))  # no element ends: the cuts have a closed form
    return s, chunking.chunks(bare, chunking.Policy(200, 50, 20, 400))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir)[1].select("sequence_id", "chunk", "tokens")


def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunked(spark, sf_dir)[1]
    return c.groupBy("sequence_id").agg(F.count("*").alias("chunks"), F.count("previous_id").alias("with_previous"), F.count("next_id").alias("with_next"))


def chunk_interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _chunked(spark, sf_dir)
    return chunking.chunk_coverage(s, c).select("book_id", "characters", "covered", "gap")


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(_sequences(spark, sf_dir), chunking.Policy(200, 50, 20, 400))
    return c.select("sequence_id", "chunk", "tokens")


def chunk_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fixed chunk widened to 400 tokens of its sequence: as much on either side, and what one lacks on the other."""
    s, c = _chunked(spark, sf_dir)
    c = durable(c.select("book_id", "sequence_id", "chunk", "chunk_id", "start", "stop"), "context-chunks")  # used twice
    wide = chunking.expand(c, s, chunking.Policy(200, 50, 20, 400))
    return wide.join(c.select("sequence_id", "chunk_id", "chunk"), ["sequence_id", "chunk_id"]).select("sequence_id", "chunk", "tokens")


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language as intervals of their lengths: overlapping ones merged."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    spans = docs.select("lang", (F.col("doc_id") * 1000).alias("start"), (F.col("doc_id") * 1000 + F.length("text")).alias("stop"))
    return chunking.merged(spans, ["lang"])


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", T.excerpt("text", 120).alias("excerpt"))


def audit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").where("text is not null").select(S.book_of().alias("book_id"), "doc_id", F.length("text").alias("size"))
    return audit.numbered_batches(docs, ["book_id"], "doc_id", "size", 18, 24_000).select("book_id", "doc_id", "batch")


def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into blocks of up to 12,000 characters."""
    return segment.group_atoms(S.line_atoms(spark, sf_dir)).select("href", "atom", "block_index")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = segment.blocks(S.line_atoms(spark, sf_dir))
    return b.select("href", "block_index", "block_id", "chars", "elements", "fingerprint", F.size("fragments").alias("fragments"))


def lexical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text predicates of the marginal rules over every line."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) != ''")
    lines = T.computed(lines, norm=T.normalized("line"))  # every predicate and the filter below read it
    own = lambda f: f("line", norm=F.col("norm"))
    flags = lines.select(
        "doc_id", "pos", own(legal).alias("legal"), own(promotion).alias("promotion"), own(editorial_credits).alias("credits"),
        own(user_licence).alias("licence"), own(backlist).alias("backlist"), own(contents_opening).alias("contents"),
        own(short_dedication).alias("dedication")
    )
    return flags.where("legal or promotion or credits or licence or backlist or contents or dedication")


def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into blocks, classified by the whole cascade."""
    blocks = durable(segment.blocks(S.line_atoms(spark, sf_dir)), "cascade-blocks")  # each is used more than once
    said = durable(_verdicts(spark, sf_dir).drop("doc_id", "language"), "cascade-verdicts")
    facts = context(S.books(spark, sf_dir), said, blocks)
    return classify(facts).select("href", "block_index", "rule_id", "role", F.col("confidence").cast("decimal(6,3)").alias("confidence"), "category", "use")


NUMBERS = (
    "log_characters", "log_elements", "document_position", "book_position", "spine_position", "link_density", "image_density", "digit_density",
    "years_per_element", "citations_per_element", "uppercase_share", "has_title", "non_linear", "starts_with_number", "same_document_previous", "same_document_next",
)


def block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the linear model sees of lines packed into blocks: numbers, and which of the others are there."""
    blocks = durable(segment.blocks(S.line_atoms(spark, sf_dir)), "feature-blocks")
    said = durable(_verdicts(spark, sf_dir).drop("doc_id", "language"), "feature-verdicts")
    facts = context(S.books(spark, sf_dir), said, blocks)
    seen = model.features(facts.join(said.select("book_id", "href", "spine_index", "votes", "linear"), ["book_id", "href", "spine_index"]))
    number = lambda n: F.round(F.try_element_at("features", F.lit(n)), 4).cast("decimal(9,4)").alias(n)
    named = F.array_sort(F.filter(F.map_keys("features"), lambda k: k.contains("=")))
    return seen.select("href", "block_index", *[number(n) for n in NUMBERS], F.array_join(named, " ").alias("named"))


def profile_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles made of labels, written as JSON, read and applied: toxic documents are notes, bad ones paratext by their
    block, good ones have a range. A wrong fingerprint in a book rejects its profile."""
    book = F.sha2(F.encode("book_id", "utf-8"), 256)
    v = _verdicts(spark, sf_dir).select("doc_id", book.alias("book_id"), "href", "text", "confidence", category_of_role("role").alias("category"))
    blocks = v.select(
        "*", F.concat(F.lit("b"), "href").alias("block_id"), F.lit("/p[1]").alias("xpath"), T.fingerprint("text", 20).alias("fingerprint"),
        use_of_category("category").alias("use"), F.lit("classifier").alias("source"), F.array().cast("array<string>").alias("evidence"),
    )
    blocks = durable(blocks, "profile-blocks")
    labels = S.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = blocks.join(labels, "doc_id")
    none, blank = F.lit(None), F.lit("")

    def note(rows: DataFrame, scope: str, label: str, start: Column = none, stop: Column = none, print_: Column = blank) -> DataFrame:
        block, place = (F.lit(""), F.lit("")) if scope == "document" else (F.col("block_id"), F.col("xpath"))
        return rows.select(
            "book_id", F.lit(scope).alias("scope"), F.lit(label).alias("label"), "href", block.alias("block_id"), place.alias("xpath"),
            F.col("fingerprint"), F.concat(F.lit("r"), "href").alias("range_id"),
            start.cast("int").alias("start"), stop.cast("int").alias("end"), print_.alias("text_fingerprint"), blank.alias("note"),
            F.lit("2024-01-01").alias("updated_at"),
        )

    wrong = F.when(F.col("doc_id") % 23 == 5, F.lit("0" * 20)).otherwise(F.col("fingerprint"))
    said = note(known.where("toxic = 1"), "document", "note").unionByName(note(
        known.where("quality = 0").withColumn("fingerprint", wrong), "block", "paratext"
    ))
    within = T.fingerprint(F.substring("text", 11, 20), 20)
    said = said.unionByName(note(known.where("quality = 1 and length(text) >= 40"), "range", "index", F.lit(10), F.lit(30), within))
    books = blocks.select("book_id").distinct().select("book_id", blank.alias("path"), blank.alias("title"), blank.alias("language"))
    made = profiles.profile_payloads(books, said, "2024-01-01", "1")
    read = made.select(F.from_json("payload", profiles.PROFILE).alias("p"), F.col("book_id").alias("profile")).select("profile", "p.*")
    corrected, ranges, _ = profiles.apply_profiles(durable(read, "profiles"), blocks.select("book_id", "href"), blocks)
    cut = ranges.groupBy("book_id", "href").agg(F.count("*").cast("int").alias("ranges"))
    return corrected.join(cut, ["book_id", "href"], "left").select(
        "doc_id", "category", "use", F.col("confidence").cast("decimal(6,3)").alias("confidence"), "source", F.coalesce("ranges", F.lit(0)).alias("ranges")
    )


def _profile_cases() -> list[str]:
    """Profiles as JSON: the first is sound, each of the others breaks one rule of the format."""

    def profile(**changes) -> str:
        block = {"block_id": "b1", "href": "h1", "xpath": "/p", "fingerprint": "f", "category": "note", "note": "", "updated_at": ""}
        range_ = {
            "range_id": "r1", "block_id": "b1", "href": "h1", "xpath": "/p", "block_fingerprint": "f", "start": 0, "end": 9, "text_fingerprint": "t",
            "category": "index", "note": "", "updated_at": "",
        }
        document = {"href": "h1", "category": "paratext", "note": "", "updated_at": ""}
        whole = {
            "schema": profiles.SCHEMA, "created_at": "", "version": "1", "category_policy_version": profiles.POLICY_VERSION,
            "book": {"sha256": "0a" * 32, "path": "", "title": "", "language": ""},
            "documents": [document | changes.pop("document", {})], "blocks": [block | changes.pop("block", {})], "ranges": [range_ | changes.pop("range", {})], "ignored_annotations": [],
        }
        for name, more in changes.pop("more", {}).items():
            whole[name].append(whole[name][0] | more)
        return json.dumps(whole | changes)

    return [
        profile(), profile(schema="other"), profile(category_policy_version=99), profile(book={"sha256": "0a", "path": "", "title": "", "language": ""}),
        profile(document={"category": "poem"}), profile(document={"category": None}), profile(document={"href": " "}), profile(block={"block_id": ""}), profile(block={"fingerprint": None}),
        profile(range={"text_fingerprint": ""}), profile(range={"start": 9}), profile(range={"start": -1}), profile(range={"end": None}),
        profile(more={"documents": {"category": "note"}}), profile(more={"blocks": {"xpath": "/q"}}), profile(more={"ranges": {"start": 20, "end": 30}}),
        profile(more={"ranges": {"range_id": "r2", "start": 5, "end": 30}}),
    ]


def profile_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with profiles, a supplier each, that break the format's rules in turn."""
    cases = F.array(*[F.lit(c) for c in _profile_cases()])
    given = S.table(spark, sf_dir, "supplier").select("s_suppkey").distinct()
    read = F.from_json(F.get(cases, (F.col("s_suppkey") % len(_profile_cases())).cast("int")), profiles.PROFILE)
    made = durable(given.select(F.col("s_suppkey").cast("string").alias("profile"), read.alias("p")).select("profile", "p.*"), "profile-cases")
    return profiles.schema_faults(made)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges in every longer document."""
    u = S.language_units(spark, sf_dir).where(F.length("text") >= 100)
    one = u.select(
        "book_id", "href", F.col("unit_id").alias("block_id"), F.concat("unit_id", F.lit("a")).alias("range_id"), F.lit(10).alias("start"),
        F.lit(30).alias("stop"), F.lit("note").alias("category")
    )
    two = u.select(
        "book_id", "href", F.col("unit_id").alias("block_id"), F.concat("unit_id", F.lit("b")).alias("range_id"), F.lit(60).alias("start"),
        F.lit(90).alias("stop"), F.lit("index").alias("category")
    )
    return one.unionByName(two)


def range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = S.language_units(spark, sf_dir)
    whole = u.select(
        "*", F.col("unit_id").alias("block_id"), F.lit(0).alias("spine_index"), F.lit(0).alias("block_index"),
        units.anchor(
            F.col("book_id"), F.col("href"), units.point(F.col("fragments"), F.col("text"), F.lit(0)),
            units.point(F.col("fragments"), F.col("text"), F.length("text"), True), F.col("text")
        ).alias("anchor")
    )
    return units.split_ranges(whole, _ranges(spark, sf_dir)).select("book_id", "order", "block_id", "category", "text")


def range_overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as ranges from their part to part + 1,000 x quantity: those that overlap an earlier one."""
    items = S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")
    )
    return profiles.overlapping(items, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "start", "end")


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made of line items: every 32 orders are a book, suppliers are documents, parts are anchors; some lead back."""
    items = S.table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 32).cast("string").alias("book_id"), (F.col("l_suppkey") % 7).cast("string").alias("a"),
        (F.col("l_partkey") % 5).cast("string").alias("b"), (F.col("l_partkey") % 11).cast("string").alias("x"),
        (F.col("l_suppkey") % 3).cast("string").alias("y"), "l_returnflag"
    )
    there = items.select("book_id", F.col("a").alias("src_href"), F.col("x").alias("src_id"), F.col("b").alias("dst_href"), F.col("y").alias("dst_id"))
    back = items.where("l_returnflag = 'R'").select(
        "book_id", F.col("b").alias("src_href"), F.col("y").alias("src_id"), F.col("a").alias("dst_href"), F.col("x").alias("dst_id")
    )
    return there.unionByName(back)


def reciprocal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.reciprocal_pairs(_arcs(spark, sf_dir))


def mutual_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.mutual_anchors(_arcs(spark, sf_dir))


def note_graph_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the link graph over books made of line items; documents have no titles, and sizes by their number."""
    arcs = _arcs(spark, sf_dir)
    cast = arcs.distinct().groupBy("book_id", F.col("src_href").alias("href")).agg(F.collect_list(F.struct("src_id", "dst_href", "dst_id")).alias("links"))
    targets = arcs.select("book_id", F.col("dst_href").alias("href")).distinct()
    docs = cast.join(targets, ["book_id", "href"], "full")
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    shaped = docs.select(
        "book_id", "href", F.col("href").cast("int").alias("spine_index"), none.alias("title"), none.alias("language"),
        F.repeat(F.lit("x"), 100 + 50 * F.col("href").cast("int")).alias("text"), empty.alias("document_epub_types"), empty.alias("document_aria"),
        F.coalesce("links", F.array()).alias("links")
    )
    return signals.graph(shaped).groupBy("book_id", "href", "role").agg(F.count("*").alias("votes"), F.round(F.sum("weight"), 4).alias("weight"))


def template_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as templates of all their distinct words: families of those that share most."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    tokens = F.array_distinct(S.words(F.lower("text")))
    books = docs.select(F.col("doc_id").alias("book_id"), tokens.alias("template"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("template_id"))
    return families.families(books).select(F.col("book_id").alias("doc_id"), "family")


def _linear_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(examples, weights): a linear model with fixed weights over the shape metrics."""
    m = signals.shape_metrics(S.sections(spark, sf_dir))
    measures = (("length", F.length("text") / 5000), ("short", F.col("short")), ("numbers", F.col("numbers")), ("paragraphs", F.col("n_paragraphs") / 20))
    parts = [F.struct(F.lit(n).alias("key"), F.least(F.lit(1.5), c.cast("double")).alias("value")) for n, c in measures]
    weights = [
        ("body", "", 0.1), ("body", "length", 1.2), ("body", "short", -0.7), ("note", "", -0.2), ("note", "short", 0.9), ("note", "numbers", 0.4),
        ("paratext", "", 0.0), ("paratext", "paragraphs", -1.1),
    ]
    return m.select(
        "doc_id", F.map_from_entries(F.array(*parts)).alias("features")
    ), spark.createDataFrame(weights, "role string, feature string, weight double")


def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles that the model gives."""
    examples, weights = _linear_model(spark, sf_dir)
    return model.score(examples, weights, ["doc_id"], 1.3).select(
        "doc_id", F.col("m_role").alias("role"), F.round("m_probability", 6).cast("decimal(9,6)").alias("probability")
    )


def calibrated_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature that fits the same model best to roles dealt by the documents' ids."""
    examples, weights = _linear_model(spark, sf_dir)
    truth = F.get(F.array(F.lit("body"), F.lit("note"), F.lit("paratext")), (F.col("doc_id") % 3).cast("int"))
    best = model.calibrate(examples.withColumn("role", truth), weights, ["doc_id"])
    return spark.createDataFrame([(float(best),)], "temperature double")


FINDING_FIELDS = {
    "kind": ("category_change", "possible_omission", "structure_issue", "category_change", "praise"),
    "scope": ("block", "document", "book", "block", "document", "shelf"),
    "href": ("d0", "d1", "d1", "d2", "d9", "", "d0"),
    "block_id": ("b0", "b1", "", "b9", "", ""),
    "category": ("note", "paratext", "work_text", "", "poem"),
    "severity": ("info", "warning", "critical", "info", "fatal"),
    "confidence": (0.5, 1.0, 0.25, None, 1.5, 0.75),
    "explanation": ("looks like notes", " seen twice ", "", "other"),
    "evidence": ("one", "one; two", "", "broken"),
}


def finding_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of line items, each order one answer: which are kept, and why the others are not."""
    items = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    drawn = items.withColumn("h", F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])))
    pick = lambda i, values, type_: F.get(
        F.array(*[F.lit(v).cast(type_) for v in values]), F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int") % len(values)
    )
    f = {n: pick(i, v, "double" if n == "confidence" else "string") for i, (n, v) in enumerate(FINDING_FIELDS.items())}
    evidence = F.when(f["evidence"] == "broken", F.lit(None)).otherwise(F.split(f["evidence"], "; "))
    finding = F.struct(
        f["kind"].alias("kind"), f["scope"].alias("scope"), f["href"].alias("href"), f["block_id"].alias("block_id"),
        f["category"].alias("proposed_category"), f["severity"].alias("severity"),
        f["confidence"].alias("confidence"), f["explanation"].alias("explanation"), evidence.alias("evidence"),
    )
    order = ("l_linenumber", "l_partkey", "l_suppkey")
    told = drawn.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, finding.alias("f")))), lambda x: x["f"]).alias("findings"))
    answers = told.select(
        F.lit("b").alias("book_id"), F.concat(F.lit("call_"), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_orderkey").alias("call"),
        F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("block"), F.lit("document"))).otherwise(F.array(F.lit("book"), F.lit("document"))).alias("scopes"),
        F.to_json(F.struct("findings")).alias("data"),
    )
    docs = spark.createDataFrame(
        [("b", "d0", {"note": 3}, "x"), ("b", "d1", {"work_text": 1, "note": 2}, "y"), ("b", "d2", {"paratext": 1}, "z")],
        "book_id string, href string, category_counts map<string,long>, visible_text_excerpt string"
    )
    columns = "book_id string, href string, block_id string, spine_index int, block_index int, xpath string, fingerprint string, shape string, title string, text string, category string, confidence double, source string, rule_id string, evidence array<string>, epub_types array<string>, aria array<string>, markers array<string>"
    block = lambda href, name, category: ("b", href, name, 0, 0, "/p", "f", "prose", None, "text", category, 0.5, "s", "r", [], [], [], [])
    classified = spark.createDataFrame([block("d0", "b0", "note"), block("d1", "b1", "work_text"), block("d1", "b0", "paratext")], columns)
    kept, issues = audit.validate(answers, docs, classified)
    one = issues.groupBy("reason").agg(F.count("*").alias("n")).select(
        F.lit("issue").alias("what"), "reason", F.lit("").alias("kind"), F.lit("").alias("scope"), F.lit(None).cast("string").alias("current"), "n"
    )
    two = kept.groupBy("kind", "scope", "current_category", "can_override").agg(F.count("*").alias("n"))
    two = two.select(
        F.lit("finding").alias("what"), F.when(F.col("can_override"), "can override").otherwise("cannot").alias("reason"), "kind", "scope",
        F.col("current_category").alias("current"), "n"
    )
    return one.unionByName(two)


def quality_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = doc_verdicts(spark, sf_dir)
    return v.join(S.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "role").agg(F.count("*").alias("n"))


def role_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.characters_by_role(_verdicts(spark, sf_dir))


def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as accepted findings, toxic ones also annotated by hand: one annotation a document, a manual one first."""
    labels = S.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    href = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    findings = labels.where("quality = 0 or toxic = 1").select(
        F.lit("b").alias("book_id"), href.alias("finding_id"), F.lit("document").alias("scope"), href.alias("href"), none.alias("block_id"),
        none.alias("xpath"), none.alias("fingerprint"), F.lit("low quality").alias("explanation"), F.lit("paratext").alias("proposed_category"),
        F.lit(True).alias("can_override"), F.lit("2024-01-01").alias("run")
    )
    decisions = review.accept_all(findings, "2024-01-02")
    manual = labels.where("toxic = 1").select(
        F.lit("b").alias("book_id"), F.lit("document").alias("scope"), F.lit("note").alias("label"), href.alias("href"), none.alias("block_id"),
        none.alias("xpath"), none.alias("fingerprint"), none.alias("range_id"), F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"), none.alias("text_fingerprint"), F.lit("by hand").alias("note"), F.lit("2023-12-31").alias("updated_at"),
        F.lit(False).alias("deleted")
    )
    return review.annotations_for_export(findings, decisions, manual).select("href", "label", "note", "updated_at")


def profile_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as JSON from labels: how many corrections and ignored labels each holds."""
    docs = S.table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("book_id"), "doc_id"
    ).join(S.table(spark, sf_dir, "labels"), "doc_id")
    none = F.lit(None).cast("string")
    notes = docs.select(
        "book_id", F.lit("document").alias("scope"),
        F.when(F.col("toxic") == 1, "mixed").when(F.col("quality") == 0, "paratext").otherwise("work_text").alias("label"),
        F.col("doc_id").cast("string").alias("href"), none.alias("block_id"), none.alias("xpath"), none.alias("fingerprint"), none.alias("range_id"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), none.alias("text_fingerprint"), none.alias("note"),
        none.alias("updated_at")
    )
    books = notes.select("book_id").distinct().select("book_id", none.alias("path"), none.alias("title"), none.alias("language"))
    made = profiles.profile_payloads(books, notes, "2024-01-01", "1").withColumn("p", F.from_json("payload", profiles.PROFILE))
    return made.select(
        "book_id", F.size("p.documents").alias("documents"), F.size("p.ignored_annotations").alias("ignored"),
        F.col("p.category_policy_version").alias("policy")
    )


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of a source as an EPUB file: a heading and a p element a line."""
    for frame in frames:
        out = []
        for book_id, rows in frame.itertuples(index=False):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
                rows = sorted(rows, key=lambda r: r["doc_id"])
                for r in rows:
                    body = "".join(f"<p>{escape(x)}</p>" for x in "".join(c for c in r["text"] if c >= " " or c in "\n\t").split("\n") if x.strip())
                    z.writestr(f"d{r['doc_id']}.xhtml", f"<html><body><h1>Chapter {r['doc_id']}</h1>{body}</body></html>")
                items = "".join(f'<item id="d{r["doc_id"]}" href="d{r["doc_id"]}.xhtml"/>' for r in rows)
                refs = "".join(f'<itemref idref="d{r["doc_id"]}"/>' for r in rows)
                z.writestr(
                    "p.opf",
                    f'<package version="3.0"><metadata><title>{escape(book_id)}</title><language>en</language></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>'
                )
            out.append((book_id, data.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Books of up to 500 documents, packed as EPUB files and read back by the whole dataflow."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null").select(
        F.concat_ws("-", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 500).cast("string")).alias("path"),
        F.struct("doc_id", "text").alias("r")
    )
    files = docs.groupBy("path").agg(F.collect_list("r").alias("rows")).mapInPandas(_pack, "path string, content binary")
    return Corpus.from_files(files)


def epub_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return c.blocks().join(c.books.select("book_id", F.col("title").alias("book")), "book_id").select(
        "book", "href", "order", "shape", F.length("text").alias("chars"), "category", "classification_rule"
    )


def epub_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return c.coverage.join(c.books.select("book_id", F.col("title").alias("book")), "book_id").select(
        "book", "visible", "classified", "main", "notes", "excluded", "valid"
    )


def verify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    records = c.chunks("all").select("book_id", "chunk_id", "anchor")
    return c.verify_sources(records).groupBy("verified").agg(F.count("*").alias("n"))


ALL = (
    shape_metrics, shape_votes, position_votes, doc_verdicts, category_coverage, title_roles, normalize_text, text_fingerprint, duplicate_units,
    page_visible_text, page_paragraphs, page_toc_links, page_headings, href_resolve,
    hard_sequences, filtered_sequences, sequence_offsets, conversation_runs, find_text, token_counts, fixed_chunks, chunk_neighbours,
    chunk_interval_coverage, semantic_chunks, chunk_contexts, interval_merge, excerpts, audit_batches, packed_blocks,
    line_blocks, lexical_flags, rule_cascade, block_features, profile_precedence, profile_faults, range_split, range_overlap_violations, reciprocal_pairs, mutual_anchors,
    note_graph_votes, template_families, softmax_scores, calibrated_temperature, finding_cases, quality_confusion, role_characters,
    review_merge, profile_payloads, epub_blocks, epub_coverage, verify_sources,
)
