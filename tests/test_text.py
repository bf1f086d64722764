"""Text and lexical functions, as columns over literals."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import lexical as X
from quire.functions import text as T
from quire.functions import vocab as V


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


def test_normalized(value):
    assert value(T.normalized(F.lit("  Prefazióne — L’ÉTÉ, №5 "))) == " prefazione l'ete 5 "
    assert value(T.normalized(F.lit(None).cast("string"))) == "  "
    for text in ("Ångström ñandú", "ǅ ﬁ ½ ٣", "naïve é", "ẞ Fußnote"):
        assert value(T.normalized(F.lit(text))) == T.normal(text)


def test_fingerprints(value):
    want = lambda s, n: hashlib.sha256(" ".join(s.split()).casefold().encode()).hexdigest()[:n]
    for text in ("Straße  und Gasse", "ΟΔΟΣ", "plain", "ﬂ İ"):
        assert value(T.fingerprint(F.lit(text), 20)) == want(text, 20)
    assert value(T.joined_id(F.lit("a"), F.lit(3))) == hashlib.sha256(b"a\x003").hexdigest()[:24]


def test_paths(value):
    assert value(T.resolve(F.lit("a/b/c.html"), F.lit("../d%2B+e.html#f"))) == "a/d++e.html"
    assert value(T.resolve(F.lit("a/b.html"), F.lit("#f"))) == "a/b.html"
    assert value(T.unquote(F.lit("100%"))) == "100%"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2019", "2019"), ("2019-02", "2019-02"), ("2019-02-30", None), ("2019-02-28T10:00:00Z", "2019-02-28"), ("0999", None), ("2019-13", None),
        ("May 2019", None)
    ]
)
def test_dates(value, raw, want):
    assert value(T.iso_date(F.lit(raw))) == want


def test_markup(value):
    html = F.lit("<nav epub:type='toc'><a href='a.html'>A <i>x</i></a><a href='b.html'> </a></nav><h2>One<br></h2><p> x <b>y</b></p><p></p><script>p</script>")
    assert value(T.paragraphs(html)) == ["x y"]
    assert value(T.visible_text(html)) == "One x y"
    assert value(T.heading(html)).asDict() == {"level": 2, "text": "One"}
    assert [tuple(x) for x in value(T.toc_links(html))] == [("a.html", "A x")]


def test_excerpt(value):
    assert value(T.excerpt(F.lit("abcdefghij"), 4)) == "ab [...] ij"
    assert value(T.excerpt(F.lit("abc"), 4)) == "abc"
    assert value(T.excerpt(F.lit("abc"), 0)) == ""


@pytest.mark.parametrize(
    ("title", "language", "role"),
    [
        ("Note", "it", V.NOTE), ("Indice analitico", "it", V.ANALYTIC_INDEX), ("Indice", "it", V.CONTENTS), ("Il libro", "it", V.PARATEXT),
        ("Il libro di larga circolazione", "it", None), ("Ottocento", "it", None),
        ("Preface to the second edition", "en", V.THRESHOLD), ("N OTE", "it", V.NOTE), ("Note e riferimenti bibliografici", "it", V.NOTE),
        ("Piano del capitolo 3", "it", V.CONTENTS), ("Sources", "en", V.BIBLIOGRAPHY),
        ("Sources of the Nile", "en", None), ("Chapter 5", "it", V.BODY), ("", "it", None), (None, "it", None), ("Bibliographie", "de-AT", V.BIBLIOGRAPHY),
    ],
)
def test_title_roles(value, title, language, role):
    found = value(X.title_role(F.lit(title).cast("string"), F.lit(language)))
    assert (found["role"] if found else None) == role


@pytest.mark.parametrize(
    ("markers", "role"),
    [
        (["toc", "footnote"], V.NOTE), (["footnote", "toc"], V.CONTENTS), (["footnote-link"], None), (["footnote-036"], V.NOTE), (["bible"], None),
        (["biblio-1sp"], V.BIBLIOGRAPHY), (["autore-frontespizio"], V.PARATEXT), (["fn_t"], V.NOTE), (["dedicato"], None), ([], None)
    ],
)
def test_markers(value, markers, role):
    found = value(X.marker_role(F.array(*[F.lit(m) for m in markers]).cast("array<string>")))
    assert (found["role"] if found else None) == role


def test_texts(value):
    yes = lambda c: value(c) is True
    assert yes(X.numbered_notes(F.lit("[1] a [2] b [3] c"), F.lit(3))) and not yes(X.numbered_notes(F.lit("[1] a [3] b [2] c"), F.lit(3)))
    assert yes(X.short_dedication(F.lit("A Justine"))) and not yes(X.short_dedication(F.lit("Justine a casa")))
    assert yes(X.promotion(F.lit("Follow us! Shop online today"))) and not yes(X.promotion(F.lit("Follow us")))
    assert yes(X.legal(F.lit("© 2020 Verlag X"))) and not yes(X.legal(F.lit("© 2020")))
    assert yes(X.backlist(F.lit("Il catalogo della casa editrice"))) and not yes(X.backlist(F.lit("il catalogo")))
    assert yes(X.editorial_credits(F.lit("Copy editor: A. Production editor: B"))) and not yes(X.editorial_credits(F.lit("Copy editor")))
    assert yes(X.contents_opening(F.lit("Contents one two"))) and not yes(X.contents_opening(F.lit("Contented")))
    assert yes(X.front_page_name(F.lit("f01_titlepage1.xhtml"))) and not yes(X.front_page_name(F.lit("subtitle.xhtml")))
    assert yes(X.epigraph_markers(F.array(
        F.lit("Dedication"), F.lit("extract"), F.lit("signature")
    ))) and not yes(X.epigraph_markers(F.array(F.lit("extract"))))


def test_policy(value):
    assert value(X.category_of_role(F.lit(V.UNCERTAIN))) == "work_text"
    assert value(X.use_of_role(F.lit(V.UNCERTAIN))) == V.EXCLUDED
    assert value(X.use_of_category(F.lit("note"))) == V.ON_REQUEST
