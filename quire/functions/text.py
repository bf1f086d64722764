"""Text functions as columns: normalisation, fingerprints, the reader's view of markup."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java class of the characters that count as whitespace, wider than Java's own \s.
SPACE = r"[\s\p{Z}\x85\x1c-\x1f]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: str | Column) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


@cache
def _plain_letters() -> tuple[str, str]:
    """Characters whose decomposition is one ASCII letter or digit and marks, and what is left of each."""
    source, target = [], []
    for point in range(0x80, 0x30000):
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base.isascii() and base.isalnum() and base == base.lower():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def normalized(c: str | Column) -> Column:
    """Lower case without accents; anything but a-z, 0-9 and ' is a space; one space at either end.

    Letters that decompose to an ASCII letter are translated, marks that stand alone are dropped, and all other
    characters become spaces anyway, so no Unicode normalisation is needed. Null counts as empty.
    """
    source, target = _plain_letters()

    def plain(low: Column) -> Column:
        # Translation looks every character up, so texts in ASCII are spared it.
        letters = F.regexp_replace(F.translate(low, source + "’", target + "'"), r"\p{Mn}", "")
        return F.regexp_replace(F.when(low.rlike(r"[^\x00-\x7F]"), letters).otherwise(low), r"[^0-9a-z'`]+", " ")

    words = bound(F.lower(F.coalesce(col(c), F.lit(""))), plain)
    # A backtick is an apostrophe; what it would have joined to spaces is unchanged.
    return F.concat(F.lit(" "), F.trim(F.replace(words, F.lit("`"), F.lit("'"))), F.lit(" "))


def normal(text: str | None) -> str:
    """The same for a Python constant."""
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c) != "Mn")
    return " " + " ".join("".join(c if c.isascii() and (c.isalnum() or c == "'") else " " for c in plain.replace("’", "'").replace("`", "'")).split()) + " "


def constants(values) -> Column:
    """A constant array of strings."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once even where use refers to it inside of other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns as a generator's output: the optimiser moves no filter or projection through it, so that what
    they cost is paid once a row, however often they are used after it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def has_phrase(norm: Column, phrase: str) -> Column:
    """Whether a normalized text contains the phrase as whole words."""
    return norm.contains(normal(phrase)) if normal(phrase).strip() else F.lit(False)


def has_any(norm: Column, phrases: tuple[str, ...]) -> Column:
    return bound(norm, lambda n: F.exists(constants([normal(p) for p in phrases]), lambda p: F.contains(n, p)))


def count_phrases(norm: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases a normalized text contains."""
    return bound(norm, lambda n: F.size(F.filter(constants([normal(p) for p in phrases]), lambda p: F.contains(n, p))))


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose case folding is not their lower case: one-to-one pairs, and the longer ones."""
    source, target, long = [], [], []
    for point in range(0x80, min(0x30000, sys.maxunicode)):
        char = chr(point)
        low = char.lower()
        if len(low) == 1 and (fold := low.casefold()) != low:
            if len(fold) == 1:
                source.append(low)
                target.append(fold)
            elif low not in [c for c, _ in long]:
                long.append((low, fold))
    return "".join(source), "".join(target), tuple(long)


def _ranges(chars: str, gap: int = 24) -> str:
    """A Java class of few ranges that holds these characters and some near them: what it rejects has none of them."""
    points = sorted({ord(c) for c in chars})
    spans = [[points[0], points[0]]]
    for p in points[1:]:
        if p - spans[-1][1] > gap:
            spans.append([p, p])
        spans[-1][1] = p
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def caseless(c: str | Column) -> Column:
    """Case folding as far as it keeps a text's length: letters that fold to several characters stay as they are."""
    source, target, _ = _folds()
    low = F.lower(F.replace(col(c), F.lit("İ"), F.lit("i")))
    return bound(low, lambda x: F.when(x.rlike(_ranges(source)), F.translate(x, source, target)).otherwise(x))


def casefold(c: str | Column) -> Column:
    """Caseless form of a text: lower case, and the foldings that go beyond it, where a text has such letters at all."""
    source, target, long = _folds()
    rare = [(char, fold) for char, fold in long if char != "ß"]
    pairs = F.transform(constants([char + fold for char, fold in rare]), lambda p: F.struct(F.left(p, F.lit(1)).alias("c"), F.substring(p, 2, 9).alias("f")))

    def fold(low: Column) -> Column:
        wide = F.aggregate(pairs, F.translate(low, source, target), lambda t, p: F.replace(t, p["c"], p["f"]))
        return F.when(low.rlike(r"[^\x00-\x7F]") & low.rlike(_ranges(source + "".join(char for char, _ in rare))), wide).otherwise(low)

    return bound(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")), fold)


def fingerprint(c: str | Column, length: int = 24) -> Column:
    """First hex digits of the SHA-256 of the squeezed, caseless text."""
    return squeezed_print(squeeze(c), length)


def squeezed_print(c: Column, length: int = 24) -> Column:
    """The fingerprint of a text that is squeezed already."""
    return F.substring(F.sha2(F.encode(casefold(c), "utf-8"), 256), 1, length)


def joined_id(*parts: str | Column, length: int = 24) -> Column:
    """First hex digits of the SHA-256 of the parts, joined by NUL; a null part reads None."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.encode(F.concat_ws("\0", *texts), "utf-8"), 256), 1, length)


def _by_reader(type_: str, read: Callable):
    """A column function that hands values to the EPUB reader's own code, so that there is one reading of markup."""

    @F.pandas_udf(type_)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else read(v)).astype(object)

    return run


def _document(html: str) -> dict:
    from quire.sources.epub import read_document  # the reader imports this package's vocabulary

    return read_document(html.encode(), "", set())


def _nav_titles(html: str) -> list[dict]:
    from quire.sources.epub import nav_links

    return [{"href": x.href, "title": x.label} for x in nav_links(html.encode()) if x.label and "landmarks" not in x.nav]


def visible_text(html: str | Column) -> Column:
    """Text outside of hidden containers; of markup that is no well-formed XML read lexically, with its entities."""
    return _by_reader("string", lambda h: _document(h)["text"])(col(html))


def paragraphs(html: str | Column) -> Column:
    """Texts of the p elements that have any, in order."""
    return _by_reader("array<string>", lambda h: _document(h)["paragraphs"])(col(html))


def heading(html: str | Column) -> Column:
    """struct(level, text) of the first h1-h6 element, null without one."""

    def first(h: str) -> tuple | None:
        found = _document(h)
        return (int(found["title_source"][1:]), found["title"]) if found.get("title") else None

    said = _by_reader("string", lambda h: None if (f := first(h)) is None else json.dumps({"level": f[0], "text": f[1]}))(col(html))
    return F.from_json(said, "struct<level:int,text:string>")


def toc_links(html: str | Column) -> Column:
    """array<struct<href, title>> of the links in navigation elements other than landmarks, with a text, in order."""
    return F.from_json(_by_reader("string", lambda h: json.dumps(_nav_titles(h)))(col(html)), "array<struct<href:string,title:string>>")


def resolve(base: str | Column, href: str | Column) -> Column:
    """The path that href names from within the document base: without fragment, . and .. folded, percent-decoded."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        from quire.sources import epub

        return pd.Series([None if b is None or h is None else epub.resolve(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    return run(col(base), col(href))


def unquote(c: str | Column) -> Column:
    """Percent-decoding that leaves + alone; what is no escape stays."""
    safe = F.regexp_replace(F.replace(col(c), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(col(c).contains("%"), F.coalesce(F.try_url_decode(safe), col(c))).otherwise(col(c))


def base_name(href: str | Column) -> Column:
    return F.substring_index(col(href), "/", -1)


def iso_date(c: str | Column) -> Column:
    """The year, year-month or date that an ISO timestamp begins with, if the calendar has it; else null."""
    text = F.trim(col(c))
    pattern = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?)?)?$"
    year, month, day = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return (
        F.when((year == "") | (year < "1000"), F.lit(None))
        .when(month == "", year)
        .when(day == "", F.when(month.between("01", "12"), F.concat_ws("-", year, month)))
        .when(F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull(), F.concat_ws("-", year, month, day))
    )


def excerpt(c: str | Column, most: int) -> Column:
    """The whole squeezed text, or its head and tail of together `most` characters."""
    text = squeeze(c)
    head, tail = most // 2, most - most // 2
    if not most:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(" [...] "), F.right(text, F.lit(tail))))
