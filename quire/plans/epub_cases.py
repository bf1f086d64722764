"""Documents packed as EPUB files of every kind of markup, and read back; the SQL knows how they were packed.

Twenty consecutive documents are a book. The kind of a document's markup follows from its id, and so do its place in the
tables of contents and the reading order; what a book says about itself, and what is wrong with its archive, follows from
the book's number. XML has no control characters, so those of a text are blanks here.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.signals import all_votes, voters, whole
from quire.plans.corpus import Corpus
from quire.plans.standins import table
from quire.sources.epub import read_epubs

BOOK = 20
KINDS = ("plain", "list", "section", "notes", "mixed blocks", "bare runs", "ignored elements", "broken")
_XMLNS = 'xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"'
_OPF = 'xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"'
_LOCK = (
    '<encryption xmlns:e="http://www.w3.org/2001/04/xmlenc#"><e:EncryptedData><e:EncryptionMethod Algorithm="{}"/>'
    '<e:CipherData><e:CipherReference URI="{}"/></e:CipherData></e:EncryptedData></encryption>'
)
_FONTS = "http://www.idpf.org/2008/embedding"


def markup(n: int, lines: list[str]) -> str:
    """A document of the kind that its id asks for."""
    xs = [escape(x) for x in lines]
    head = f"<h1>Chapter {n}</h1>"
    kind = n % len(KINDS)
    if kind == 7:  # nothing but the heading is closed
        return f"<html><body><h1>Top {n}</h1>" + "".join(f"<p>{x}" for x in xs) + "<br></body>"
    wrap = ("<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")
    body = (
        lambda: head + "".join(f"<p>{x}</p>" for x in xs),
        lambda: f"<h2>List {n}</h2><ul>" + "".join(f"<li>{x}</li>" for x in xs) + "</ul>",
        lambda: f'<section epub:type="Chapter bodymatter" role="doc-chapter" class="Body Main" id="s{n}">{head}' + "".join(f'<p class="fn">{x}</p>' for x in xs) + "</section>",
        lambda: head + '<div class="Notes">' + "".join(f'<p id="n{i}"><a href="d{n - 1}.xhtml#r{i}">[{i}]</a> {x}</p>' for i, x in enumerate(xs, 1)) + "</div>",
        lambda: head + "".join(wrap[i % 3].format(x) for i, x in enumerate(xs)),
        lambda: '<div class="Mix">' + "".join(f"<p>{x}</p>" if i % 2 else x for i, x in enumerate(xs)) + "</div>",
        lambda: f"<nav>skip</nav>{head}<script>var x;</script>" + "".join(f'<p><img src="i.png"/>{x}</p>' for x in xs) + "<svg><text>no</text></svg>",
    )[kind]()
    return f'<?xml version="1.0" encoding="utf-8"?><html {_XMLNS}><head><title>hidden</title></head><body>{body}</body></html>'


def metadata(b: int) -> str:
    """Two creators, dates of either version, and what producers add, by the book's number."""
    creators = '<dc:creator id="a" opf:role="aut" opf:file-as="Doe, Jane">Jane Doe</dc:creator>'
    if b % 2 == 0:
        creators += '<dc:creator id="t">Tom Roe</dc:creator><meta refines="#t" property="role">trl EDT</meta><meta refines="#t" property="file-as">Roe, Tom</meta>'
    dates = (
        "<dc:date>2001-05-01</dc:date><dc:date>1990</dc:date>",
        '<dc:date opf:event="modification">2020</dc:date><dc:date opf:event="publication">1999-12</dc:date>',
        '<meta property="dcterms:issued">2010</meta>',
        "<dc:date>in spring</dc:date>",
    )[b % 4]
    more = (
        f'<meta name="calibre:series" content="Series {b}"/>' if b % 3 == 0 else ""
    ) + (f'<meta name="generator" content="Tool 1.{b}"/>' if b % 4 == 0 else "")
    return f"<dc:title>Book {b}</dc:title><dc:language>{('en', 'it', 'de')[b % 3]}</dc:language><dc:publisher>Press &amp; Co</dc:publisher>{creators}{dates}{more}"


def pack(b: int, documents: list[tuple[int, list[str]]]) -> bytes:
    """A book as a file: its contents in a navigation document (even numbers) or an NCX, and some with faults."""
    if b % 10 == 8:
        return b"no archive"
    out = io.BytesIO()
    numbers = [n for n, _ in documents]
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)  # noqa: E731  without the time of writing
        put("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="d{n}.xhtml"/>' for n in numbers)
        refs = ('<itemref idref="missing"/>' if b % 4 == 1 else "") + "".join(
            f'<itemref idref="i{n}"{" linear=" + chr(34) + "no" + chr(34) if n % 5 == 4 else ""}/>' for n in numbers
        )
        if b % 2 == 0:
            toc = "".join(f'<li><a href="d{n}.xhtml">TOC <b>{n}</b></a></li>' for n in numbers if n % 3 == 0)
            marks = f'<nav epub:type="landmarks"><ol><li><a epub:type="bodymatter" href="d{numbers[0]}.xhtml#s">Start</a></li></ol></nav>'
            put("OEBPS/nav.xhtml", f'<html {_XMLNS}><body><nav epub:type="toc"><ol>{toc}</ol></nav>{marks}</body></html>')
            items += '<item id="nav" href="nav.xhtml" properties="nav"/>'
        else:
            points = "".join(f'<navPoint><navLabel><text>NCX {n}</text></navLabel><content src="d{n}.xhtml"/></navPoint>' for n in numbers if n % 3 == 1)
            put("OEBPS/toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
            items += '<item id="ncx" href="toc.ncx"/>'
        spine = f'<spine{" toc=" + chr(34) + "ncx" + chr(34) if b % 2 else ""}>{refs}</spine>'
        put("OEBPS/content.opf", f'<package {_OPF} version="{3 - b % 2}.0"><metadata>{metadata(b)}</metadata><manifest>{items}</manifest>{spine}</package>')
        for n, lines in documents:
            put(f"OEBPS/d{n}.xhtml", ('<!DOCTYPE html [<!ENTITY a "b">]>' if b % 10 == 6 and n == numbers[0] else "") + markup(n, lines))
        if b % 10 == 5:
            put("../evil", "x")
        if b % 10 in (7, 9):
            put("META-INF/encryption.xml", _LOCK.format(_FONTS, f"OEBPS/d{numbers[0]}.xhtml" if b % 10 == 7 else "OEBPS/font.otf"))
    return out.getvalue()


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        files = [(f"/b{b}.epub", pack(b, sorted((r["doc_id"], list(r["lines"])) for r in rows))) for b, rows in frame.itertuples(index=False)]
        yield pd.DataFrame(files, columns=["path", "content"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the documents' books. A null text is a document without lines."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x09\\x0b-\\x1f]", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: T.squeeze(x)), lambda x: x != "")
    each = docs.select(F.floor(F.col("doc_id") / BOOK).alias("book"), F.struct("doc_id", lines.alias("lines")).alias("r"))
    return each.groupBy("book").agg(F.collect_list("r").alias("rows")).mapInPandas(_pack, "path string, content binary")


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_epubs(files(spark, sf_dir))


def epub_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each book says about itself, or why it cannot be read."""
    rows = _read(spark, sf_dir).where("book is not null").select("path", "book_id", "book.*")
    creator = lambda c: F.concat_ws(
        "|", c["name"], F.concat_ws("+", c["roles"]), F.coalesce(c["file_as"], F.lit("")), F.coalesce(c["opf_id"], F.lit(""))
    )
    said = F.concat_ws(";", F.transform("creators", creator))
    marks = F.concat_ws(";", F.transform("landmarks", lambda m: F.concat_ws("=", m["role"], m["href"])))
    return rows.select(
        "path", F.length("book_id").alias("id_length"), "version", "title", "language", "publisher", "series", "generator", said.alias("creators"),
        "date_raw", T.iso_date("date_raw").alias("published"), marks.alias("landmarks"), (F.size("template") > 0).alias("has_template"), "error",
    )


def epub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the readable books in reading order."""
    said = lambda c: F.concat_ws(" ", c)
    rows = _read(spark, sf_dir).where("document is not null").select("path", "document.*")
    return rows.select(
        "path", "href", "spine_index", "linear", "title", "title_source", "broken", "text", F.concat_ws("\n", "paragraphs").alias("paragraphs"),
        said("epub_types").alias("epub_types"),
        said("aria").alias("aria"), said("document_epub_types").alias("document_epub_types"), said("document_aria").alias("document_aria"), "images",
    )


def epub_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest blocks of every document, with the path of their element."""
    rows = _read(spark, sf_dir).where("document is not null").select("document.href", F.posexplode("document.atoms").alias("pos", "a"))
    said = lambda c: F.concat_ws(" ", F.col(f"a.{c}")).alias(c)
    return rows.select(
        "href", "pos", "a.xpath", "a.text", "a.shape", "a.title", "a.level", said("epub_types"), said("aria"), said("markers"), "a.links", "a.images"
    )


def epub_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents of the reading order."""
    rows = _read(spark, sf_dir).where("document is not null").select("document.href", F.explode("document.links").alias("l"))
    return rows.select("href", "l.src_id", "l.dst_href", "l.dst_id")


_SPACES = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
_DOCS = f"""l AS (SELECT doc_id AS n, doc_id // {BOOK} AS b, doc_id % {len(KINDS)} AS k, 'OEBPS/d' || doc_id || '.xhtml' AS href,
  list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x09\\x0b-\\x1f]', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '{_SPACES}', ' ', 'g'))), lambda x: x <> '') AS xs
  FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT *, list_transform(xs, lambda x: replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS es, min(n) OVER (PARTITION BY b) AS first, b % 10 IN (5, 6, 7, 8) AS bad FROM l),
d AS (SELECT * FROM e WHERE NOT bad)"""
_NUMBERED = "list_transform(range(1, len({0}) + 1), lambda i: '[' || i || '] ' || {0}[i])"
_ODD = "list_transform(list_filter(range(1, len({0}) + 1), lambda i: i % 2 = 0), lambda i: {0}[i])"
BOOKS = f"""
WITH {_DOCS}, g AS (SELECT b, min(n) AS first, b % 10 IN (5, 7, 8) AS shut FROM e GROUP BY b)
SELECT '/b' || b || '.epub' AS path, 64 AS id_length, CASE WHEN shut THEN NULL WHEN b % 2 = 0 THEN '3.0' ELSE '2.0' END AS version, CASE WHEN NOT shut THEN 'Book ' || b END AS title,
  CASE WHEN NOT shut THEN ['en', 'it', 'de'][b % 3 + 1] END AS language, CASE WHEN NOT shut THEN 'Press & Co' END AS publisher,
  CASE WHEN NOT shut AND b % 3 = 0 THEN 'Series ' || b END AS series, CASE WHEN NOT shut AND b % 4 = 0 THEN 'Tool 1.' || b END AS generator,
  CASE WHEN shut THEN '' WHEN b % 2 = 0 THEN 'Jane Doe|aut|Doe, Jane|a;Tom Roe|trl+edt|Roe, Tom|t' ELSE 'Jane Doe|aut|Doe, Jane|a' END AS creators,
  CASE WHEN NOT shut THEN ['2001-05-01', '1999-12', '2010', 'in spring'][b % 4 + 1] END AS date_raw,
  CASE WHEN NOT shut THEN ['2001-05-01', '1999-12', '2010', NULL][b % 4 + 1] END AS published,
  CASE WHEN NOT shut AND b % 10 <> 6 AND b % 2 = 0 THEN 'bodymatter=OEBPS/d' || first || '.xhtml' ELSE '' END AS landmarks,
  CASE WHEN NOT shut AND b % 10 <> 6 THEN true END AS has_template,
  CASE b % 10 WHEN 5 THEN 'unsafe EPUB archive: ''../evil'': its member path leads out of the archive'
    WHEN 6 THEN 'unsafe EPUB archive: ''OEBPS/d' || first || '.xhtml'' declares an entity'
    WHEN 7 THEN 'unsafe EPUB archive: content is encrypted: OEBPS/d' || first || '.xhtml' WHEN 8 THEN 'not a readable ZIP archive: File is not a zip file' END AS error
FROM g
"""
DOCUMENTS = f"""
WITH {_DOCS}
SELECT '/b' || b || '.epub' AS path, href, (row_number() OVER (PARTITION BY b ORDER BY n) - 1 + CASE WHEN b % 4 = 1 THEN 1 ELSE 0 END)::INTEGER AS spine_index, n % 5 <> 4 AS linear,
  CASE WHEN b % 2 = 0 AND n % 3 = 0 THEN 'TOC ' || n WHEN b % 2 = 1 AND n % 3 = 1 THEN 'NCX ' || n WHEN k = 1 THEN 'List ' || n WHEN k = 7 THEN 'Top ' || n WHEN k <> 5 THEN 'Chapter ' || n END AS title,
  CASE WHEN b % 2 = 0 AND n % 3 = 0 OR b % 2 = 1 AND n % 3 = 1 THEN 'TOC' WHEN k = 1 THEN 'h2' WHEN k <> 5 THEN 'h1' END AS title_source, k = 7 AS broken,
  trim(CASE k WHEN 1 THEN 'List ' || n WHEN 5 THEN '' WHEN 7 THEN 'Top ' || n ELSE 'Chapter ' || n END || ' ' ||
       array_to_string(CASE k WHEN 3 THEN {_NUMBERED.format("xs")} WHEN 7 THEN es ELSE xs END, ' ')) AS text,
  array_to_string(CASE WHEN k IN (1, 4, 7) THEN [] WHEN k = 3 THEN {_NUMBERED.format("es")} WHEN k = 5 THEN {_ODD.format("es")} ELSE es END, chr(10)) AS paragraphs,
  CASE WHEN k = 2 THEN 'bodymatter chapter' ELSE '' END AS epub_types, CASE WHEN k = 2 THEN 'doc-chapter' ELSE '' END AS aria,
  CASE WHEN k = 2 THEN 'bodymatter chapter' ELSE '' END AS document_epub_types, CASE WHEN k = 2 THEN 'doc-chapter' ELSE '' END AS document_aria,
  CASE WHEN k = 6 THEN len(xs) ELSE 0 END::INTEGER AS images
FROM d
"""
ATOMS = f"""
WITH {_DOCS},
heads AS (SELECT n, k, href, 0 AS i, '/html[1]/body[1]/' || CASE k WHEN 1 THEN 'h2[1]' WHEN 2 THEN 'section[1]/h1[1]' ELSE 'h1[1]' END AS xpath,
            CASE k WHEN 1 THEN 'List ' ELSE 'Chapter ' END || n AS text, 'title' AS shape FROM d WHERE k NOT IN (5, 7)),
lines AS (SELECT n, k, href, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x, len(xs) AS many FROM d WHERE k <> 7),
blocks AS (SELECT n, k, href, i, '/html[1]/body[1]/' || CASE k WHEN 0 THEN 'p[' || i || ']' WHEN 1 THEN 'ul[1]/li[' || i || ']' WHEN 2 THEN 'section[1]/p[' || i || ']' WHEN 3 THEN 'div[1]/p[' || i || ']'
             WHEN 4 THEN ['blockquote', 'pre', 'table'][(i - 1) % 3 + 1] || '[' || ((i - 1) // 3 + 1) || ']' WHEN 6 THEN 'p[' || i || ']'
             ELSE CASE WHEN many = 1 THEN 'div[1]' WHEN i % 2 = 1 THEN 'div[1]/text()[' || (i + 1) // 2 || ']' ELSE 'div[1]/p[' || i // 2 || ']' END END AS xpath,
             CASE WHEN k = 3 THEN '[' || i || '] ' || x ELSE x END AS text,
             CASE k WHEN 1 THEN 'list_item' WHEN 4 THEN ['quote', 'code', 'table'][(i - 1) % 3 + 1] ELSE 'prose' END AS shape FROM lines),
wholes AS (SELECT n, k, href, 0 AS i, '/' AS xpath, 'Top ' || n || CASE WHEN len(xs) > 0 THEN ' ' ELSE '' END || array_to_string(xs, ' ') AS text, 'mixed' AS shape FROM d WHERE k = 7),
marks AS (SELECT n, len(xs) >= 3 AND list_transform(regexp_extract_all(array_to_string({_NUMBERED.format("xs")}, ' '), '\\[\\s*([0-9]{{1,4}})\\s*\\]', 1)[:3], lambda x: x::INTEGER) = [1, 2, 3] AS numbered FROM d WHERE k = 3),
every AS (SELECT * FROM heads UNION ALL SELECT * FROM blocks UNION ALL SELECT * FROM wholes)
SELECT href, (row_number() OVER (PARTITION BY every.n ORDER BY i) - 1)::INTEGER AS pos, xpath, text, shape,
  CASE WHEN k = 1 THEN 'List ' || every.n WHEN k NOT IN (5, 7) THEN 'Chapter ' || every.n END AS title, CASE WHEN k = 1 THEN 2 WHEN k NOT IN (5, 7) THEN 1 END AS level,
  CASE WHEN k = 2 THEN 'bodymatter chapter' ELSE '' END AS epub_types, CASE WHEN k = 2 THEN 'doc-chapter' ELSE '' END AS aria,
  CASE WHEN k = 2 THEN 'body main s' || every.n || CASE WHEN i > 0 THEN ' fn' ELSE '' END WHEN k = 3 AND i > 0 THEN 'notes' || CASE WHEN numbered THEN ' __numbered_linked_notes__' ELSE '' END || ' n' || i
       WHEN k = 5 THEN 'mix' ELSE '' END AS markers, CASE WHEN k = 3 AND i > 0 THEN 1 ELSE 0 END AS links, CASE WHEN k = 6 AND i > 0 THEN 1 ELSE 0 END AS images
FROM every LEFT JOIN marks ON marks.n = every.n
"""
LINKS = f"""
WITH {_DOCS}
SELECT d.href, 'n' || i AS src_id, o.href AS dst_href, 'r' || i AS dst_id
FROM (SELECT n, b, href, unnest(range(1, len(xs) + 1)) AS i FROM d WHERE k = 3) d JOIN d AS o ON o.n = d.n - 1 AND o.b = d.b
"""


def epub_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in plain documents, resolved in the books as read: within a line, over two lines, and three ways to be wrong."""
    packed = files(spark, sf_dir)
    corpus = Corpus.from_files(packed)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x09\\x0b-\\x1f]", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: T.squeeze(x)), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % len(KINDS) == 0).select("doc_id", F.posexplode(lines).alias("i", "x"), lines.alias("xs"))
    ids = packed.select(F.col("path"), F.sha2("content", 256).alias("epub_sha256"))
    after = F.get("xs", F.col("i") + 1)
    two = (F.col("i") % 2 == 1) & after.isNotNull()
    start = F.when(two, 0).otherwise((F.length("x") / 3).cast("int"))
    stop = F.when(two, (F.length(after) / 2).cast("int") + 1).otherwise(F.length("x"))
    said = F.when(two, F.concat("x", F.lit(" "), F.left(after, stop))).otherwise(F.substring("x", start + 1, F.length("x")))
    fault = F.when(F.col("i") % 10 == 4, "text").when(F.col("i") % 10 == 6, "element").when(F.col("i") % 10 == 8, "place").otherwise("none")
    point = lambda i, text, offset: F.struct(
        F.concat(F.lit("/html[1]/body[1]/p["), (i + 1 + F.when(fault == "place", 100_000).otherwise(0)).cast("string"), F.lit("]")).alias("xpath"),
        offset.cast("int").alias("offset"),
        F.when(fault == "element", F.lit("0" * 20)).otherwise(T.fingerprint(text, 20)).alias("element_fingerprint"), F.lit("").alias("context"),
    )
    end = F.when(two, point(F.col("i") + 1, after, stop)).otherwise(point(F.col("i"), F.col("x"), stop))
    anchor = F.struct(
        "epub_sha256", F.concat(F.lit("OEBPS/d"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("href"),
        point(F.col("i"), F.col("x"), start).alias("start"), end.alias("end"),
        F.when(fault == "text", F.lit("0" * 24)).otherwise(T.fingerprint(said, 24)).alias("text_fingerprint"), F.lit("").alias("quote"),
    )
    at = F.concat(F.lit("/b"), F.floor(F.col("doc_id") / BOOK).cast("string"), F.lit(".epub"))
    sources = docs.withColumn("path", at).join(ids, "path").select("doc_id", "i", fault.alias("fault"), anchor.alias("anchor"))
    return corpus.verify_sources(sources).select("doc_id", "i", "fault", "resolved", "verified")


# A book is shut out as a whole if the blocks of a document do not account for its visible text. Here that is so where a
# document without well-formed markup has many entities, since what is visible of it is read with them.
ANCHORS = f"""
WITH {_DOCS},
v AS (SELECT b, length('Top ' || n || ' ' || array_to_string(es, ' ')) AS visible, length('Top ' || n || ' ' || array_to_string(xs, ' ')) AS classified FROM e WHERE k = 7),
shut AS (SELECT DISTINCT b FROM v WHERE abs(visible - classified) > greatest(64, round_even(visible * 0.01, 0)) UNION SELECT b FROM e WHERE bad),
x AS (SELECT n AS doc_id, shut.b IS NOT NULL AS bad, unnest(range(0, len(xs))) AS i, xs FROM e LEFT JOIN shut ON shut.b = e.b WHERE k = 0),
y AS (SELECT *, xs[i + 1] AS x, xs[i + 2] AS after, i % 2 = 1 AND i + 2 <= len(xs) AS two, CASE i % 10 WHEN 4 THEN 'text' WHEN 6 THEN 'element' WHEN 8 THEN 'place' ELSE 'none' END AS fault FROM x)
SELECT doc_id, i::INTEGER AS i, fault, CASE WHEN bad OR fault IN ('element', 'place') THEN NULL WHEN two THEN x || ' ' || left(after, length(after) // 2 + 1) ELSE substr(x, length(x) // 3 + 1) END AS resolved,
       NOT bad AND fault = 'none' AS verified FROM y
"""


def epub_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What declarations and titles vote, over books as read."""
    corpus = Corpus.from_files(files(spark, sf_dir))
    votes = whole(all_votes({k: v for k, v in voters(corpus.books, corpus.documents_raw, corpus.blocks_raw).items() if k in ("declarations", "titles")}))
    return votes.select("href", "signal", "role", F.col("weight").cast("decimal(4,2)").alias("weight"), "evidence", "confirms")


def epub_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of plain documents in the books that are not shut out, with the places in the source that prove them."""
    corpus = Corpus.from_files(files(spark, sf_dir))
    number = F.regexp_extract("href", r"d(\d+)\.xhtml$", 1).cast("long")
    a = F.col("anchor")
    return corpus.units("all").where(number % len(KINDS) == 0).select(
        "href", F.length("text").alias("chars"), a["start"]["xpath"].alias("first"), a["start"]["offset"].alias("first_offset"),
        a["end"]["xpath"].alias("last"), a["end"]["offset"].alias("last_offset"),
        a["text_fingerprint"].alias("fingerprint"), a["quote"].alias("quote"),
    )


VOTES = f"""
WITH {_DOCS}, named AS (SELECT *, (b % 2 = 0 AND n % 3 = 0) OR (b % 2 = 1 AND n % 3 = 1) AS listed FROM d)
SELECT href, 'title' AS signal, 'body' AS role, 3.5::DECIMAL(4,2) AS weight, 'title «Chapter ' || n || '» contains «chapter»' AS evidence, false AS confirms FROM named WHERE NOT listed AND k NOT IN (1, 5, 7)
UNION ALL SELECT href, 'declarations', 'body', 6, 'epub:type or ARIA declares body', false FROM named WHERE k = 2
UNION ALL SELECT href, 'declarations', 'body', 3, 'landmark bodymatter', false FROM named WHERE b % 2 = 0 AND n = first
"""
UNITS = f"""
WITH RECURSIVE {_DOCS},
v AS (SELECT b, length('Top ' || n || ' ' || array_to_string(es, ' ')) AS visible, length('Top ' || n || ' ' || array_to_string(xs, ' ')) AS classified FROM e WHERE k = 7),
shut AS (SELECT DISTINCT b FROM v WHERE abs(visible - classified) > greatest(64, round_even(visible * 0.01, 0))),
sec AS (SELECT href, list_prepend('Chapter ' || n, xs) AS ps FROM d ANTI JOIN shut USING (b) WHERE k = 0),
sized AS (SELECT href, i, length(ps[i]) AS s FROM (SELECT href, ps, unnest(range(1, len(ps) + 1)) AS i FROM sec)),
pack(href, i, block, size) AS (SELECT href, i, 0, s FROM sized WHERE i = 1
  UNION ALL SELECT z.href, z.i, CASE WHEN p.size + z.s > 12000 THEN p.block + 1 ELSE p.block END, CASE WHEN p.size + z.s > 12000 THEN z.s ELSE p.size + z.s END FROM pack p JOIN sized z ON z.href = p.href AND z.i = p.i + 1),
u AS (SELECT pack.href, block, min(i) AS a, max(i) AS z, string_agg(ps[i], ' ' ORDER BY i) AS text, any_value(ps) AS ps FROM pack JOIN sec ON sec.href = pack.href GROUP BY pack.href, block)
SELECT href, length(text) AS chars, '/html[1]/body[1]/' || CASE WHEN a = 1 THEN 'h1[1]' ELSE 'p[' || a - 1 || ']' END AS first, 0 AS first_offset,
       '/html[1]/body[1]/' || CASE WHEN z = 1 THEN 'h1[1]' ELSE 'p[' || z - 1 || ']' END AS last, length(ps[z]) AS last_offset,
       substr(sha256(replace(lower(text), 'ß', 'ss')), 1, 24) AS fingerprint, left(text, 180) AS quote FROM u
"""


def epub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the books that are not shut out."""
    corpus = Corpus.from_files(files(spark, sf_dir))
    return corpus.metadata().select(
        "path", "title", F.concat_ws(";", "authors").alias("authors"), "language", "publisher", "publication_date", "publication_date_raw"
    )


def epub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for a retrieval index of plain documents: chunks of up to 350 tokens that end with an element where they can."""
    corpus = Corpus.from_files(files(spark, sf_dir))
    m = F.col("metadata")
    number = F.regexp_extract(m["source"]["href"], r"d(\d+)\.xhtml$", 1).cast("long")
    return corpus.rag_records().where(number % len(KINDS) == 0).select(
        m["source"]["href"].alias("href"), "chunk", m["token_count"].alias("tokens"), m["category"].alias("category"),
        m["document_title"].alias("title"), m["book"]["title"].alias("book"),
        m["previous_id"].isNotNull().alias("follows"), m["next_id"].isNotNull().alias("goes_on"), F.length("id").alias("id_length"),
    )


_SHUT = f"""v AS (SELECT b, length('Top ' || n || ' ' || array_to_string(es, ' ')) AS visible, length('Top ' || n || ' ' || array_to_string(xs, ' ')) AS classified FROM e WHERE k = 7),
shut AS (SELECT DISTINCT b FROM v WHERE abs(visible - classified) > greatest(64, round_even(visible * 0.01, 0)) UNION SELECT b FROM e WHERE bad)"""
METADATA = f"""
WITH {_DOCS}, {_SHUT}
SELECT DISTINCT '/b' || b || '.epub' AS path, 'Book ' || b AS title, 'Jane Doe' AS authors, ['en', 'it', 'de'][b % 3 + 1] AS language, 'Press & Co' AS publisher,
  ['2001-05-01', '1999-12', '2010', NULL][b % 4 + 1] AS publication_date, ['2001-05-01', '1999-12', '2010', 'in spring'][b % 4 + 1] AS publication_date_raw FROM e ANTI JOIN shut USING (b)
"""
_TOKEN = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]"
RECORDS = f"""
WITH RECURSIVE {_DOCS}, {_SHUT},
atom AS (SELECT n, b, href, unnest(range(0, len(xs) + 1)) AS i, list_prepend('Chapter ' || n, xs) AS ps FROM d ANTI JOIN shut USING (b) WHERE k = 0),
size AS (SELECT n, b, href, i, sum(len(regexp_extract_all(ps[i + 1], '{_TOKEN}'))) OVER (PARTITION BY n ORDER BY i)::BIGINT AS stop FROM atom),
s AS (SELECT n, b, href, list(stop ORDER BY i) AS ends, max(stop) AS total FROM size GROUP BY n, b, href),
cut(n, chunk, first, last) AS (
  SELECT n, 0, 0::BIGINT, CASE WHEN total <= 350 THEN total ELSE coalesce(list_max(list_filter(ends, lambda x: x BETWEEN 80 AND 350)), 350) END::BIGINT FROM s
  UNION ALL SELECT w.n, w.chunk, w.first, CASE WHEN s.total - w.first <= 350 THEN s.total ELSE greatest(w.first + 1, coalesce(list_max(list_filter(s.ends, lambda x: x BETWEEN w.first + 80 AND w.first + 350)), w.first + 350)) END::BIGINT
    FROM (SELECT cut.n, chunk + 1 AS chunk, greatest(cut.first + 1, cut.last - 40) AS first, cut.last FROM cut) w JOIN s ON s.n = w.n WHERE w.last < s.total)
SELECT href, chunk, last - first AS tokens, 'work_text' AS category, 'Chapter ' || cut.n AS title, 'Book ' || b AS book, chunk > 0 AS follows, last < total AS goes_on, 24 AS id_length
FROM cut JOIN s ON s.n = cut.n
"""
