"""What titles, texts, markers and file names say about a role. All are columns; phrase lists are constants in the plan."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import vocab as V
from quire.functions.text import SPACE, bound, casefold, col, constants, count_phrases, has_any, has_phrase, normal, normalized


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a constant map, null for other keys."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(mapping)), "map<string,string>"), key)


def is_one_of(title: str | Column, phrases: tuple[str, ...]) -> Column:
    """Whether the whole normalized title is one of the phrases; false for null and empty titles."""
    found = F.trim(normalized(title)).isin(sorted({normal(p).strip() for p in phrases}))
    return F.coalesce(col(title) != "", F.lit(False)) & found


@cache
def _ranked(first: str | None) -> tuple[tuple[str, str, str], ...]:
    """(padded phrase, role, phrase) in order of trial: languages, the given one first, then long phrases first."""
    whole = {normal(p).strip() for p in V.EDITORIAL_HEADINGS}
    out = []
    for lang in sorted(V.TITLE_PHRASES, key=lambda x: x != first):
        entries = [(role, p) for role, phrases in V.TITLE_PHRASES[lang].items() for p in phrases]
        for role, phrase in sorted(entries, key=lambda e: -len(e[1])):
            if not (role == V.PARATEXT and normal(phrase).strip() in whole):  # those only count as a whole title
                out.append((normal(phrase), role, phrase))
    return tuple(out)


def title_role(title: str | Column, language: str | Column) -> Column:
    """struct(role, phrase) that a title points to, null without one.

    Whole editorial headings come first, then chapter plans and note headings, then the phrases: the book's language
    before the others, longer before shorter, some only as the whole title.
    """
    base = F.lower(F.substring_index(F.coalesce(col(language), F.lit("")), "-", 1))
    every = {lang or "": [{"p": p, "role": r, "phrase": f, "whole": f in V.WHOLE_TITLE_ONLY} for p, r, f in _ranked(lang)] for lang in (None, *V.TITLE_PHRASES)}
    by_language = F.from_json(F.lit(json.dumps(every)), "map<string,array<struct<p:string,role:string,phrase:string,whole:boolean>>>")
    said = lambda role, phrase: F.struct(F.lit(role).alias("role"), (F.lit(phrase) if isinstance(phrase, str) else phrase).alias("phrase"))

    def decide(norm: Column) -> Column:
        bare = F.trim(norm)
        ranked = F.coalesce(F.try_element_at(by_language, base), F.element_at(by_language, F.lit("")))
        hit = F.get(F.filter(ranked, lambda e: F.contains(norm, e["p"]) & (~e["whole"] | (norm == e["p"]))), F.lit(0))
        return (
            F.when(F.coalesce(col(title), F.lit("")) == "", F.lit(None))
            .when(bare.isin(sorted({normal(p).strip() for p in V.EDITORIAL_HEADINGS})), said(V.PARATEXT, bare))
            .when(bare.rlike(r"^p\s?iano\s+del\s+capitolo(?:\s+\d+)?$"), said(V.CONTENTS, V.CHAPTER_PLAN))
            .when(bare.isin(*V.SPACED_NOTE_HEADINGS), said(V.NOTE, "note"))
            .when(
                has_phrase(norm, V.NOTES_AND_REFERENCES) | norm.rlike(r"(?<![0-9a-z_])n\s+ote\s+e\s+riferimenti\s+bibliografici(?![0-9a-z_])"),
                said(V.NOTE, V.NOTES_AND_REFERENCES)
            )
            .otherwise(bound(hit, lambda h: F.when(h.isNotNull(), F.struct(h["role"].alias("role"), h["phrase"].alias("phrase")))))
        )

    return bound(normalized(title), decide)


def marker_role(markers: str | Column) -> Column:
    """struct(role, marker) of the marker nearest to the element that names a role; markers run from the root down."""

    def one(token: Column) -> Column:
        role = lookup(V.MARKER_ROLE, token)
        for pattern, family in V.MARKER_FAMILIES:
            role = F.coalesce(role, F.when(token.rlike(f"^(?:{pattern})$"), F.lit(family)))
        return F.struct(role.alias("role"), token.alias("marker"))

    tokens = F.transform(F.reverse(F.coalesce(col(markers), F.array().cast("array<string>"))), lambda m: casefold(F.trim(m)))
    return F.get(F.filter(F.transform(tokens, one), lambda r: r["role"].isNotNull()), F.lit(0))


def numbered_notes(text: str | Column, links: str | Column) -> Column:
    """Whether a text with three links or more begins [1] and counts on [2], [3]."""
    numbers = F.transform(F.slice(F.regexp_extract_all(col(text), F.lit(r"\[\s*(\d{1,4})\s*\]"), F.lit(1)), 1, 3), lambda n: n.cast("int"))
    return F.coalesce(
        (col(links) >= 3) & col(text).rlike(rf"^{SPACE}*\[{SPACE}*1{SPACE}*\]") & (numbers == F.array(F.lit(1), F.lit(2), F.lit(3))), F.lit(False)
    )


def declared_roles(epub_types: str | Column, aria: str | Column, references: bool = True) -> Column:
    """Roles that epub:type and ARIA tokens declare, one for each token; references: whether note references count."""
    types = F.filter(col(epub_types), lambda t: F.lit(references) | (t != "noteref"))
    arias = F.filter(col(aria), lambda t: F.lit(references) | (t != "doc-noteref"))
    both = F.concat(F.transform(types, lambda t: lookup(V.EPUB_TYPE_ROLE, t)), F.transform(arias, lambda t: lookup(V.ARIA_ROLE, t)))
    return F.filter(both, lambda r: r.isNotNull())


def joined(*parts: str | Column) -> Column:
    """Non-empty parts with one space between them."""
    return F.array_join(F.filter(F.array(*[col(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), " ")


def searchable_paratext(titles: tuple, epub_types: str | Column, aria: str | Column) -> Column:
    """Dedications, acknowledgements and epigraphs, by declaration or by a phrase in a title."""
    declared = F.arrays_overlap(col(epub_types), constants(V.SEARCHABLE_EPUB_TYPES)) | F.arrays_overlap(col(aria), constants(V.SEARCHABLE_ARIA))
    return F.coalesce(declared, F.lit(False)) | has_any(normalized(joined(*titles)), V.SEARCHABLE_PARATEXT)


def _tokens(markers: str | Column) -> Column:
    return F.transform(col(markers), lambda m: casefold(F.trim(m)))


def epigraph_markers(markers: str | Column) -> Column:
    """Whether dedication, extract and signature stand together."""
    return F.size(F.array_intersect(_tokens(markers), constants(("dedication", "extract", "signature")))) == 3


def dedication_markers(markers: str | Column) -> Column:
    return F.exists(_tokens(markers), lambda m: m.rlike(r"^(?:dedication|dedica\d*)$"))


def short_dedication(text: str | Column, norm: Column | None = None) -> Column:
    """A nominal dedication: a preposition and few words, or a longer one with a list of names after a colon."""
    bare = F.trim(normalized(text) if norm is None else norm)
    words = F.split(bare, " ")
    short = (F.size(words) <= 8) & (F.length(bare) <= 80)
    listed = (F.size(words) <= 18) & (F.length(bare) <= 160) & col(text).contains(":") & col(text).contains(",")
    return F.coalesce((F.size(words) >= 2) & F.get(words, F.lit(0)).isin(*V.DEDICATION_PREPOSITIONS) & (short | listed), F.lit(False))


def promotion(text: str | Column, norm: Column | None = None) -> Column:
    norm = normalized(text) if norm is None else norm
    return (count_phrases(norm, V.PROMOTION) >= 2) | (has_any(norm, V.STRONG_PROMOTION) & F.coalesce(col(text).rlike(V.URL), F.lit(False)))


def collection_reference(text: str | Column, norm: Column | None = None) -> Column:
    return has_any(normalized(text) if norm is None else norm, V.COLLECTION_REFERENCES)


def editorial_credits(*texts: str | Column, norm: Column | None = None) -> Column:
    return count_phrases(normalized(joined(*texts)) if norm is None else norm, V.EDITORIAL_CREDITS) >= 2


def user_licence(*texts: str | Column, norm: Column | None = None) -> Column:
    return has_any(normalized(joined(*texts)) if norm is None else norm, V.USER_LICENCES)


def backlist(*texts: str | Column, norm: Column | None = None) -> Column:
    norm = normalized(joined(*texts)) if norm is None else norm
    pairs = [has_phrase(norm, catalogue) & has_any(norm, publishers) for catalogue, publishers in V.CATALOGUE_PUBLISHERS]
    out = has_any(norm, V.BACKLIST)
    for pair in pairs:
        out = out | pair
    return out


def legal(*texts: str | Column, norm: Column | None = None) -> Column:
    """Copyright and a publisher's mark, or two printing marks."""
    raw = F.concat_ws(" ", *[F.coalesce(col(t), F.lit("")) for t in texts])
    norm = normalized(raw) if norm is None else norm
    return ((raw.contains("©") | has_any(norm, V.RIGHTS)) & has_any(norm, V.PUBLISHER_MARKS)) | (count_phrases(norm, V.PRINTING_MARKS) >= 2)


def contents_opening(text: str | Column, norm: Column | None = None) -> Column:
    opened = lambda n: F.exists(constants([normal(p) for p in V.CONTENTS_OPENINGS]), lambda p: F.startswith(n, p))
    return bound(normalized(text) if norm is None else norm, opened)


def front_page_name(name: str | Column) -> Column:
    return F.coalesce(col(name).rlike(rf"(?i)^(?:{V.FRONT_PAGE_NAME})$"), F.lit(False))


def use_of_role(role: str | Column) -> Column:
    return F.when(col(role).isin(*V.TEXTUAL), V.MAIN).when(col(role) == V.NOTE, V.ON_REQUEST).otherwise(V.EXCLUDED)


def category_of_role(role: str | Column) -> Column:
    return F.coalesce(lookup(V.ROLE_CATEGORY, col(role)), F.lit("work_text"))


def use_of_category(category: str | Column) -> Column:
    return F.coalesce(lookup(V.CATEGORY_USE, col(category)), F.lit(V.EXCLUDED))
