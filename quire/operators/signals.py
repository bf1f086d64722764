"""Five independent signals that vote on the role of a document.

Every function returns votes: book_id, href, role, weight, evidence, confirms (whether the vote only supports a role that
another vote asserts), signal, signal_order, vote_order. Documents carry their book's language and title.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import vocab as V
from quire.functions.lexical import declared_roles, front_page_name, lookup, title_role
from quire.functions.text import SPACE, base_name, computed, normalized
from quire.operators.links import arcs, mutual_anchors, reciprocal_pairs
from quire.sources.tables import durable

SIGNALS = ("declarations", "graph", "title", "shape", "position")
MIN_SOURCES, RETURN_SHARE, MIN_PAIRS = 3, 0.6, 4
_DOC = ["book_id", "href", "spine_index"]


def _votes(
    df: DataFrame, signal: str, role: str | Column, weight: float | Column, evidence: Column | str, order: Column | int = 0,
    confirms: bool | Column = False
) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "book_id",
        "href",
        as_col(role).alias("role"),
        as_col(weight).cast("double").alias("weight"),
        as_col(evidence).alias("evidence"),
        as_col(confirms).alias("confirms"),
        F.lit(signal).alias("signal"),
        F.lit(SIGNALS.index(signal)).alias("signal_order"),
        as_col(order).cast("int").alias("vote_order"),
    )


def declarations(books: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """What the publisher declares: on the document, on nearly all of its blocks, or in the landmarks."""
    local = F.array_distinct(declared_roles("epub_types", "aria", references=False))
    sole = F.when(F.size(local) == 1, F.get(local, F.lit(0)))
    per_doc = blocks.groupBy(*_DOC).agg(F.count("*").alias("n"), F.count(sole).alias("n_sole"), F.collect_set(sole).alias("sole"))
    share = (F.col("n_sole") / F.col("n") >= 0.7) & (F.size("sole") == 1)
    both = documents.join(per_doc, _DOC, "left")
    own = declared_roles("document_epub_types", "document_aria")
    said = both.select(
        *_DOC, "epub_types", "aria",
        F.concat(
            own, F.when(share, F.array_repeat(F.get("sole", F.lit(0)), F.col("n_sole").cast("int"))).otherwise(F.array().cast("array<string>"))
        ).alias("roles")
    )
    counted = said.select("book_id", "href", "roles", F.posexplode(F.array_distinct("roles")).alias("i", "role"))
    n = F.size(F.filter("roles", lambda r: r == F.col("role")))
    declared = _votes(
        counted, "declarations", F.col("role"), F.when(n > 2, 6.0).otherwise(5.0), F.concat(F.lit("epub:type or ARIA declares "), F.col("role")),
        F.col("i")
    )
    references = said.where((F.size("roles") == 0) & (F.array_contains("epub_types", "noteref") | F.array_contains("aria", "doc-noteref")))
    marks = books.select("book_id", F.posexplode("landmarks").alias("i", "m")).select("book_id", "i", "m.href", F.col("m.role").alias("mark"))
    role = F.when(F.col("mark") == "bodymatter", V.BODY).otherwise(lookup(V.EPUB_TYPE_ROLE, F.col("mark")))
    return (
        declared.unionByName(_votes(references, "declarations", V.BODY, 2.0, "has note references"))
        .unionByName(_votes(
            marks.withColumn("role", role).where("role is not null"), "declarations", F.col("role"), 3.0, F.concat(F.lit("landmark "), F.col("mark")),
            F.col("i") + 1000
        ))
    )


def explicit_role(documents: DataFrame) -> Column:
    """The role that a document declares, or that its title or file name gives; null without one."""
    declared = F.array_distinct(declared_roles("document_epub_types", "document_aria"))
    name = base_name("href")
    return F.coalesce(
        F.when(F.size(declared) == 1, F.get(declared, F.lit(0))),
        title_role("title", "language")["role"],
        F.when(name.rlike(f"(?i){V.NOTE_NAME}"), V.NOTE).when(name.rlike(f"(?i){V.INDEX_NAME}"), V.ANALYTIC_INDEX).when(
            name.rlike(f"(?i){V.BIBLIOGRAPHY_NAME}"), V.BIBLIOGRAPHY
        ),
    )


def graph(documents: DataFrame) -> DataFrame:
    """Note apparatus by its links: many documents refer to it and it links back, or anchors pair up exactly.

    A book in which a link leads to a document of the reading order that is not in the archive gets no such votes.
    """
    links = arcs(documents)
    facts = documents.select(
        "book_id", "href", F.length("text").alias("chars"), explicit_role(documents).alias("explicit"), "title",
        title_role("title", "language")["role"].alias("title_role"), "spine_index"
    ).dropDuplicates(["book_id", "href"])
    # Both are used on either side of joins below: as tables, titles are read and links are gathered once.
    facts = durable(facts, "graph-facts")
    links = durable(links, "graph-links")
    outer = links.where("src_href != dst_href").select("book_id", "src_href", "dst_href").distinct()
    lost = outer.join(facts.select("book_id", F.col("href").alias("dst_href")), ["book_id", "dst_href"], "left_anti").select("book_id").distinct()
    source = facts.select("book_id", F.col("href").alias("src_href"), F.col("explicit").alias("src_explicit"), F.col("chars").alias("src_chars"))
    target = facts.select(
        "book_id", F.col("href").alias("dst_href"), F.col("explicit").alias("dst_explicit"), F.col("chars").alias("dst_chars"),
        F.col("title").alias("dst_title"), F.col("title_role").alias("dst_title_role"), F.col("spine_index").alias("dst_order")
    )
    returns = outer.select("book_id", F.col("dst_href").alias("src_href"), F.col("src_href").alias("dst_href"), F.lit(True).alias("returned"))
    edges = (
        outer.join(source, ["book_id", "src_href"])
        .join(target, ["book_id", "dst_href"])
        .where(~F.coalesce(F.col("dst_explicit").isin(*V.APPARATUS), F.lit(False)) & ~F.coalesce(
            F.col("src_explicit").isin(*V.APPARATUS, V.NOTE), F.lit(False)
        ))
        .join(returns, ["book_id", "src_href", "dst_href"], "left")
        .join(mutual_anchors(links), ["book_id", "src_href", "dst_href"], "left")
        .join(lost, "book_id", "left_anti")
    )
    sums = edges.groupBy("book_id", "dst_href").agg(
        F.count("*").alias("n"),
        F.count("returned").alias("n_returned"),
        F.sum(F.coalesce("pairs", F.lit(0))).alias("pairs"),
        F.min(F.coalesce("pairs", F.lit(0))).alias("least"),
        F.greatest(F.sum("src_chars"), F.lit(1)).alias("src_chars"),
        F.first("dst_chars").alias("dst_chars"),
        F.first("dst_title").alias("dst_title"),
        F.first("dst_title_role").alias("dst_title_role"),
        F.first("dst_order").alias("dst_order"),
    )
    named = base_name("dst_href").rlike(f"(?i){V.NOTE_NAME}") | F.coalesce(F.col("dst_title_role") == V.NOTE, F.lit(False))
    many = (F.col("n") >= MIN_SOURCES) & (F.col("n_returned") >= F.greatest(F.lit(2), F.ceil(F.col("n") * RETURN_SHARE)))
    few = (
        (F.col("n") < MIN_SOURCES)
        & (F.col("pairs") >= F.when(named, 1).otherwise(MIN_PAIRS))
        & (F.col("least") > 0)
        & (F.coalesce("dst_title", F.lit("")).eqNullSafe("") | F.coalesce(F.col("dst_title_role") == V.NOTE, F.lit(False)))
        & (F.col("dst_chars") < F.col("src_chars"))
        & (F.col("pairs") / F.greatest(F.col("dst_chars"), F.lit(1)) >= F.col("pairs") / F.col("src_chars") * 1.5)
    )
    notes = sums.where(many | few).withColumn("weight", F.when(many, F.when(F.col("n") >= 8, 3.5).otherwise(2.5)).otherwise(F.when(named, 3.5).otherwise(2.5)))
    target_votes = _votes(
        notes.withColumn("href", F.col("dst_href")), "graph", V.NOTE, F.col("weight"),
        F.when(
            many, F.format_string("%d documents refer to it, %d returns", "n", "n_returned")
        ).otherwise(F.format_string("%d exact anchor pairs with %d documents", "pairs", "n")),
        F.col("dst_order") * 2
    )
    source_votes = _votes(
        edges.join(notes.select("book_id", "dst_href"), ["book_id", "dst_href"]).withColumn("href", F.col("src_href")), "graph", V.BODY, 0.8,
        "refers to a note apparatus", F.col("dst_order") * 2 + 1
    )
    inner = reciprocal_pairs(links).groupBy("book_id", "href").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAIRS).join(lost, "book_id", "left_anti")
    inner_votes = _votes(inner, "graph", V.BODY, 1.2, F.format_string("%d reciprocal anchor pairs inside", "n"), 1_000_000)
    return target_votes.unionByName(source_votes).unionByName(inner_votes)


def titles(documents: DataFrame) -> DataFrame:
    said = documents.withColumn("said", title_role("title", "language")).where("said is not null")
    weight = F.when(F.col("title_source").isin("TOC", "h1"), 3.5).otherwise(2.5)
    return _votes(
        said, "title", F.col("said.role"), weight,
        F.concat(F.lit("title «"), F.left("title", F.lit(40)), F.lit("» contains «"), F.col("said.phrase"), F.lit("»"))
    )


def count_matches(text: str, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))


def progressive(paragraphs: Column) -> Column:
    """Whether six paragraphs or more begin with a number and three in five of those go up by one."""
    found = F.transform(paragraphs, lambda p: F.regexp_extract(p, rf"^\[?(\d{{1,4}})(?:[\]\.\)]|{SPACE})", 1))
    numbers = F.transform(F.filter(found, lambda n: n != ""), lambda n: n.cast("int"))
    ups = F.filter(F.transform(numbers, lambda n, i: n - F.get(numbers, i - 1)), lambda d: d == 1)
    return (F.size(numbers) >= 6) & (F.size(ups) >= F.size(numbers) * 0.6)


def shape_metrics(documents: DataFrame) -> DataFrame:
    """Adds n_paragraphs, mean_chars, years, citations, numbers (a paragraph) and short (share below 90 characters)."""
    ps = F.filter("paragraphs", lambda p: p != "")
    n = F.greatest(F.lit(1), F.col("n_paragraphs"))
    staged = documents.withColumn("_ps", ps).withColumn("n_paragraphs", F.size("_ps"))
    return computed(
        staged,
        mean_chars=F.aggregate("_ps", F.lit(0).cast("long"), lambda a, p: a + F.length(p)) / n,
        years=count_matches("text", V.YEAR) / n,
        citations=count_matches("text", V.CITATION) / n,
        numbers=count_matches("text", V.NUMBER) / n,
        short=F.size(F.filter("_ps", lambda p: F.length(p) < 90)) / n,
        progressive=progressive(F.col("_ps")),
    ).drop("_ps")


def shapes(documents: DataFrame) -> DataFrame:
    """What the form of the paragraphs suggests, for documents of eight paragraphs and 400 characters or more."""
    long = documents.where((F.size(F.filter("paragraphs", lambda p: p != "")) >= 8) & (F.length("text") >= 400))
    m = shape_metrics(long.select("book_id", "href", "paragraphs", "text"))
    mean, years, cites, numbers, short = (F.col(c) for c in ("mean_chars", "years", "citations", "numbers", "short"))
    verdict = (
        F.when(
            ((mean < 320) & (years > 0.45) & (cites > 0.55)) | ((mean < 180) & (years > 0.65) & (short > 0.25)),
            F.struct(F.lit(V.BIBLIOGRAPHY).alias("role"), F.lit(2.5).alias("weight"))
        )
        .when((short > 0.75) & (numbers > 1.6) & (mean < 110), F.struct(F.lit(V.ANALYTIC_INDEX).alias("role"), F.lit(2.5).alias("weight")))
        .when((mean < 400) & (short > 0.4) & F.col("progressive"), F.struct(F.lit(V.NOTE).alias("role"), F.lit(2.0).alias("weight")))
        .when(mean > 450, F.struct(F.lit(V.BODY).alias("role"), F.lit(1.5).alias("weight")))
    )
    said = m.withColumn("said", verdict).where("said is not null")
    return _votes(
        said, "shape", F.col("said.role"), F.col("said.weight"),
        F.format_string("%.0f characters a paragraph, %.1f years, %.1f citation marks, %.1f numbers", "mean_chars", "years", "citations", "numbers")
    )


def position(documents: DataFrame) -> DataFrame:
    """What the place in the reading order suggests, in books of four documents or more."""
    placed = documents.withColumn("n_documents", F.count("*").over(Window.partitionBy("book_id"))).where("n_documents >= 4")
    chars = F.length("text")
    slim = placed.select("book_id", "href", "spine_index", "linear", "title", "paragraphs", "language", "n_documents", "text")
    # Only texts below 700 characters, or at the front below 3,000, can be votes for paratext: others are not normalized.
    few = F.when(chars < 3000, F.col("text"))
    measured = computed(
        slim, q=F.col("spine_index") / (F.col("n_documents") - 1), chars=chars, norm=F.trim(normalized(few)),
        said=title_role(F.when(chars < 700, F.col("text")), "language"),
    )
    title = F.trim(normalized("title"))
    phrase = F.trim(normalized(F.col("said.phrase")))
    heading = F.col("said.role").isin(*V.TEXTUAL) & (phrase != "") & ((F.col("norm") == phrase) | F.startswith("norm", F.concat(phrase, F.lit(" "))))
    words = F.size(F.filter(F.split("text", f"{SPACE}+"), lambda w: w != ""))
    sentence = F.col("chars").between(20, 300) & (words >= 4) & F.col("text").rlike(
        rf"(?:\p{{L}}{{2}}\.|[!?…])(?:{SPACE}|$)"
    ) & ~F.col("text").rlike(V.SHORT_EDITORIAL)
    content = F.col("text").rlike(V.CAPTION) | sentence | F.coalesce(heading, F.lit(False))
    front = (F.col("spine_index") <= 3) & (F.col("chars") < 700) & front_page_name(base_name("href"))
    untitled = F.coalesce("title", F.lit("")) == ""
    short = F.col("chars") < 3000
    plain = computed(measured, content=F.when(short, content))
    divider = (F.col("chars") < 700) & (F.size("paragraphs") <= 2) & ~F.col("content") & (
        (~untitled & (F.col("norm") == title)) | (untitled & (F.col("chars") < 200))
    )
    opening = (F.col("q") <= 0.08) & short & ~F.col("content")
    marked = computed(plain, weight=F.when(front, 2.0).when(opening, 1.2).when(divider, 0.8))
    evidence = F.when(
        F.col("weight") == 2.0, "front page name among the first documents"
    ).when(F.col("weight") == 1.2, "short and at the front").otherwise("a divider or half title")
    late = F.col("q") >= 0.88
    vote = lambda when, role, weight, said, order, confirms=False: F.when(
        when, F.struct(
            F.lit(role).alias("role"), (weight if isinstance(weight, Column) else F.lit(weight)).cast("double").alias("weight"),
            (said if isinstance(said, Column) else F.lit(said)).alias("evidence"), F.lit(confirms).alias("confirms"), F.lit(order).alias("order")
        )
    )
    # All votes of a document at once: it is read and measured one time.
    cast = marked.select("book_id", "href", F.explode(F.array_compact(F.array(
        vote(~F.col("linear"), V.NOTE, 1.0, "auxiliary in the reading order", 0),
        vote(F.col("weight").isNotNull(), V.PARATEXT, F.col("weight"), evidence, 1),
        vote(late, V.BIBLIOGRAPHY, 0.6, "at the end", 2, True),
        vote(late, V.ANALYTIC_INDEX, 0.4, "at the end", 3, True),
    ))).alias("v"))
    return _votes(cast, "position", F.col("v.role"), F.col("v.weight"), F.col("v.evidence"), F.col("v.order"), F.col("v.confirms"))


def voters(books: DataFrame, documents: DataFrame, blocks: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The five signals by name, in the order of their votes."""
    return {
        "declarations": lambda: declarations(books, documents, blocks),
        "graph": lambda: graph(documents),
        "titles": lambda: titles(documents),
        "shape": lambda: shapes(documents),
        "position": lambda: position(documents),
    }


def all_votes(named: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """(votes, faults): the votes of all signals, written at once. If that fails each signal is written by itself: one that
    fails has no votes and its reason in faults, and the others decide.
    """
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    try:
        return durable(union([vote() for vote in named.values()]), "votes"), {}
    except Exception:  # whatever a voter fails on, the other signals still stand; which one it is shows below
        parts, faults = [], {}
    for name, vote in named.items():
        try:
            parts.append(durable(vote(), f"votes-{name}"))
        except Exception as error:
            faults[name] = f"{type(error).__name__}: {str(error)[:300]}"
    if not parts:
        raise RuntimeError(f"no signal could vote: {faults}")
    return union(parts), faults


def whole(votes: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """The votes, where no signal failed: what the others say is no result of all of them."""
    if votes[1]:
        raise RuntimeError(f"signals that failed: {votes[1]}")
    return votes[0]
