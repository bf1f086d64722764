"""SQL for another engine (DuckDB) with the results of quire.plans.table_queries."""

from __future__ import annotations

import unicodedata

from quire.functions import vocab as V
from quire.plans.table_queries import FINDING_FIELDS, TITLES

_WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def normal(phrase: str) -> str:
    """A phrase as it stands in a normal form: plain letters, digits and apostrophes, with a blank at either end."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", phrase.lower().replace("’", "'")) if not unicodedata.combining(c))
    return f" {' '.join(''.join(c if c.isascii() and (c.isalnum() or c == chr(39)) else ' ' for c in bare).split())} "


def _trial(first: str | None) -> list[tuple[str, str, str]]:
    """(phrase in normal form, role, phrase) in the order in which titles are held against them: the given language, then the
    others as listed; in each the longest first. Headings that count as a whole title only are no phrases of paratext."""
    headings = {normal(h) for h in V.EDITORIAL_HEADINGS}
    out = []
    for lang in [x for x in V.TITLE_PHRASES if x == first] + [x for x in V.TITLE_PHRASES if x != first]:
        listed = [(normal(p), role, p) for role, phrases in V.TITLE_PHRASES[lang].items() for p in phrases]
        out += sorted((x for x in listed if x[1] != "paratext" or x[0] not in headings), key=lambda x: len(x[2]), reverse=True)
    return out


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _norm(x: str) -> str:
    return f"(' ' || trim(regexp_replace(replace(replace(strip_accents(lower(coalesce({x}, ''))), '’', ''''), '`', ''''), '[^0-9a-z'']+', ' ', 'g')) || ' ')"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _phrases(values) -> str:
    return "[" + ", ".join(_q(normal(v)) for v in values) + "]"


def _count(norm: str, values) -> str:
    return f"len(list_filter({_phrases(values)}, lambda p: contains({norm}, p)))"


def _any(norm: str, values) -> str:
    return f"({_count(norm, values)} > 0)"


BOOK = "concat(coalesce(source, ''), '-', doc_id // 500)"
SEC = f"""sec AS (
  SELECT doc_id, {BOOK} AS book_id, doc_id::VARCHAR AS href, row_number() OVER (PARTITION BY {BOOK} ORDER BY doc_id) - 1 AS spine_index,
         {_squeeze('text')} AS text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_squeeze('x')}), lambda x: x <> '') AS ps, lang AS language
  FROM documents WHERE text IS NOT NULL)"""

MET = r"""met0 AS (
  SELECT *, len(ps) AS n, greatest(1, len(ps))::DOUBLE AS d,
         list_transform(list_filter(list_transform(ps, lambda p: regexp_extract(p, '^\[?([0-9]{1,4})(?:[\]\.\)]|\s)', 1)), lambda x: x <> ''), lambda x: x::INTEGER) AS nums
  FROM sec),
met AS (
  SELECT *, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0) / d AS mean_chars, len(regexp_extract_all(text, '\b(?:1[5-9][0-9]{2}|20[0-4][0-9])\b')) / d AS years,
         len(regexp_extract_all(text, '(?i)\b(?:cfr|ibid|ibidem|op\. cit|art\. cit|vol|pp|p\.|ed\.|trad|a cura di)\b')) / d AS citations, len(regexp_extract_all(text, '\b[0-9]+\b')) / d AS numbers,
         len(list_filter(ps, lambda p: length(p) < 90)) / d AS short,
         len(nums) >= 6 AND len(list_filter(range(2, len(nums) + 1), lambda i: nums[i] = nums[i - 1] + 1)) >= len(nums) * 0.6 AS progressive
  FROM met0)"""

SHAPE = """shape AS (
  SELECT doc_id, book_id, href, role, CASE role WHEN 'note' THEN 2.0 WHEN 'body' THEN 1.5 ELSE 2.5 END::DOUBLE AS weight FROM (
    SELECT *, CASE WHEN (mean_chars < 320 AND years > 0.45 AND citations > 0.55) OR (mean_chars < 180 AND years > 0.65 AND short > 0.25) THEN 'bibliography'
                   WHEN short > 0.75 AND numbers > 1.6 AND mean_chars < 110 THEN 'analytic_index'
                   WHEN mean_chars < 400 AND short > 0.4 AND progressive THEN 'note' WHEN mean_chars > 450 THEN 'body' END AS role
    FROM met WHERE n >= 8 AND length(text) >= 400) WHERE role IS NOT NULL)"""


def _said(source: str, key: str, title: str, language: str, name: str) -> str:
    """CTEs that give (key, role, phrase) for titles: the first phrase that fits in the order of trial."""
    rows = [(lang or "", i, p, r, f, f in V.WHOLE_TITLE_ONLY) for lang in (None, *V.TITLE_PHRASES) for i, (p, r, f) in enumerate(_trial(lang))]
    values = ", ".join(f"({_q(lang)}, {i}, {_q(p)}, {_q(r)}, {_q(f)}, {str(w).lower()})" for lang, i, p, r, f, w in rows)
    known = ", ".join(_q(x) for x in V.TITLE_PHRASES)
    headings = "[" + ", ".join(sorted({_q(normal(h).strip()) for h in V.EDITORIAL_HEADINGS})) + "]"
    return f"""{name}_lex(lang, ord, p, role, phrase, whole) AS (VALUES {values}),
{name}_t AS (SELECT {key} AS key, {title} AS title, {_norm(title)} AS norm, CASE WHEN split_part(lower(coalesce({language}, '')), '-', 1) IN ({known}) THEN split_part(lower({language}), '-', 1) ELSE '' END AS lang FROM {source} WHERE coalesce({title}, '') <> ''),
{name}_hit AS (SELECT key, arg_min(x.role, ord) AS role, arg_min(x.phrase, ord) AS phrase FROM {name}_t t JOIN {name}_lex x ON x.lang = t.lang AND contains(t.norm, x.p) AND (NOT x.whole OR t.norm = x.p) GROUP BY key),
{name} AS (SELECT t.key, CASE WHEN list_contains({headings}, trim(norm)) THEN 'paratext' WHEN regexp_full_match(trim(norm), 'p\\s?iano\\s+del\\s+capitolo(?:\\s+[0-9]+)?') THEN 'contents'
    WHEN trim(norm) IN ('n ota', 'n ote', 'n otes') THEN 'note' WHEN contains(norm, ' note e riferimenti bibliografici ') OR contains(norm, ' n ote e riferimenti bibliografici ') THEN 'note' ELSE h.role END AS role,
    CASE WHEN list_contains({headings}, trim(norm)) THEN trim(norm) ELSE h.phrase END AS phrase FROM {name}_t t LEFT JOIN {name}_hit h USING (key))"""


POS = (
    _said(
        "(SELECT href, book_id, CASE WHEN length(text) < 700 THEN text END AS short_text, language FROM sec)", "book_id || '/' || href", "short_text",
        "language", "stx"
    )
    + f""",
pos0 AS (SELECT sec.*, count(*) OVER (PARTITION BY book_id) AS n, length(text) AS chars, trim({_norm('text')}) AS norm, stx.role AS said, trim({_norm('stx.phrase')}) AS phrase FROM sec LEFT JOIN stx ON stx.key = book_id || '/' || href),
pos1 AS (SELECT *, spine_index / (n - 1) AS q,
    regexp_matches(text, '(?i)(?:^|\\s)(?:f\\s*ig(?:ura)?|figure|abbildung|tavola)\\.?\\s*[0-9]|\\b(?:tavola|foto|photo|photograph|fotografia)\\b')
    OR (chars BETWEEN 20 AND 300 AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) >= 4 AND regexp_matches(text, '(?:\\p{{L}}{{2}}\\.|[!?…])(?:\\s|$)') AND NOT regexp_matches(text, '(?i)\\b(?:isbn|copyright|editore|edizioni|publisher|verlag)\\b|www\\.|https?://|©|all rights reserved'))
    OR coalesce(said IN ('body', 'threshold', 'appendix') AND phrase <> '' AND (norm = phrase OR starts_with(norm, phrase || ' ')), false) AS content
  FROM pos0 WHERE n >= 4),
pos2 AS (SELECT *, CASE WHEN q <= 0.08 AND chars < 3000 AND NOT content THEN 1.2 WHEN chars < 700 AND len(ps) <= 2 AND NOT content AND chars < 200 THEN 0.8 END::DOUBLE AS weight FROM pos1),
position AS (
  SELECT doc_id, book_id, href, 'paratext' AS role, weight, false AS confirms, 1 AS ord FROM pos2 WHERE weight IS NOT NULL
  UNION ALL SELECT doc_id, book_id, href, 'bibliography', 0.6, true, 2 FROM pos2 WHERE q >= 0.88
  UNION ALL SELECT doc_id, book_id, href, 'analytic_index', 0.4, true, 3 FROM pos2 WHERE q >= 0.88)"""
)

VERDICT = """votes AS (SELECT doc_id, role, weight, false AS confirms, 0 AS ord FROM shape UNION ALL SELECT doc_id, role, weight, confirms, ord FROM position),
tally AS (SELECT doc_id, role, sum(weight) AS score, min(ord) AS first FROM votes GROUP BY doc_id, role HAVING bool_or(NOT confirms)),
top AS (SELECT doc_id, role, score / sum(score) OVER (PARTITION BY doc_id) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS k FROM tally),
verdict AS (
  SELECT sec.doc_id, sec.book_id, sec.text, CASE WHEN t.role IS NULL THEN CASE WHEN length(text) > 1500 THEN 'body' ELSE 'uncertain' END WHEN share < 0.34 AND t.role <> 'body' THEN 'uncertain' ELSE t.role END AS role,
         (CASE WHEN t.role IS NULL THEN CASE WHEN length(text) > 1500 THEN 0.3 ELSE 0.0 END ELSE round_even(share, 3) END)::DECIMAL(6, 3) AS confidence
  FROM sec LEFT JOIN top t ON t.doc_id = sec.doc_id AND t.k = 1),
verdict_c AS (SELECT *, CASE role WHEN 'note' THEN 'note' WHEN 'bibliography' THEN 'bibliography' WHEN 'analytic_index' THEN 'index' WHEN 'contents' THEN 'index' WHEN 'paratext' THEN 'paratext' ELSE 'work_text' END AS category FROM verdict)"""

ALL_VERDICTS = f"{SEC}, {MET}, {SHAPE}, {POS}, {VERDICT}"
USE = "CASE category WHEN 'work_text' THEN 'main' WHEN 'note' THEN 'on_request' ELSE 'excluded' END"

UNITS = f"""unit AS (SELECT {BOOK} AS book_id, doc_id::VARCHAR AS unit_id, row_number() OVER (PARTITION BY {BOOK} ORDER BY doc_id) - 1 AS ord, {_squeeze('text')} AS text,
    CASE lang WHEN 'en' THEN 'work_text' WHEN 'de' THEN 'note' WHEN 'fr' THEN 'bibliography' ELSE 'index' END AS category FROM documents WHERE text IS NOT NULL)"""


def _seq(where: str = "true") -> str:
    return f"""{UNITS},
run0 AS (SELECT *, coalesce(ord = lag(ord) OVER w + 1 AND category = lag(category) OVER w, false) AS goes_on FROM unit WHERE {where} WINDOW w AS (PARTITION BY book_id ORDER BY ord)),
run AS (SELECT *, sum((NOT goes_on)::INTEGER) OVER (PARTITION BY book_id ORDER BY ord) AS run FROM run0),
seq AS (SELECT book_id, run, category, count(*) AS n_units, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text,
    substr(sha256(book_id || chr(0) || 'all' || chr(0) || category || chr(0) || arg_min(unit_id, ord) || chr(0) || arg_max(unit_id, ord)), 1, 24) AS sequence_id FROM run GROUP BY book_id, run, category)"""


TOKEN = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]"
CHUNKED = f"""{_seq()},
tok AS (SELECT *, len(regexp_extract_all(text, '{TOKEN}')) AS t FROM seq),
chunk AS (SELECT sequence_id, book_id, t, unnest(range(0, CASE WHEN t = 0 THEN 0 WHEN t <= 200 THEN 1 ELSE 1 + ceil((t - 200) / 180)::BIGINT END)) AS chunk FROM tok)"""

HTML = r"regexp_replace(html, '(?is)<nav\b.*?</nav\s*>', ' ', 'g')"


def _untag(x: str) -> str:
    return _squeeze(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


def _hidden(x: str) -> str:
    for tag in ("head", "script", "style", "nav", "svg"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    return x


LINK = r"""(?is)<a\b[^>]*href\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>"""

_HEADING = rf"regexp_extract({HTML}, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', 1)"

ARCS = """item AS (SELECT (l_orderkey // 32)::VARCHAR AS book_id, (l_suppkey % 7)::VARCHAR AS a, (l_partkey % 5)::VARCHAR AS b, (l_partkey % 11)::VARCHAR AS x, (l_suppkey % 3)::VARCHAR AS y, l_returnflag FROM lineitem),
arc AS (SELECT book_id, a AS src, x AS src_id, b AS dst, y AS dst_id FROM item UNION ALL SELECT book_id, b, y, a, x FROM item WHERE l_returnflag = 'R')"""

_n = "norm"
_pairs = " OR ".join(f"({_any(_n, (c,))} AND {_any(_n, ps)})" for c, ps in V.CATALOGUE_PUBLISHERS)

#: Predicates of a text in the column line with its normal form in norm.
FLAGS = f"""((contains(line, '©') OR {_any(_n, V.RIGHTS)}) AND {_any(_n, V.PUBLISHER_MARKS)}) OR {_count(_n, V.PRINTING_MARKS)} >= 2 AS legal,
  {_count(_n, V.PROMOTION)} >= 2 OR ({_any(_n, V.STRONG_PROMOTION)} AND regexp_matches(line, '(?i)(?:https?://|www\\.)')) AS promotion, {_count(_n, V.EDITORIAL_CREDITS)} >= 2 AS credits, {_any(_n, V.USER_LICENCES)} AS licence,
  {_any(_n, V.BACKLIST)} OR {_pairs} AS backlist, len(list_filter({_phrases(V.CONTENTS_OPENINGS)}, lambda p: starts_with(norm, p))) > 0 AS contents,
  len(string_split(trim(norm), ' ')) >= 2 AND list_contains([{', '.join(_q(p) for p in V.DEDICATION_PREPOSITIONS)}], split_part(trim(norm), ' ', 1)) AND ((len(string_split(trim(norm), ' ')) <= 8 AND length(trim(norm)) <= 80) OR (len(string_split(trim(norm), ' ')) <= 18 AND length(trim(norm)) <= 160 AND contains(line, ':') AND contains(line, ','))) AS dedication"""

#: Documents as chapters of EPUB files: a heading, then the lines that have any text without control characters.
EPUB_SEC = f"""sec AS (SELECT {BOOK} AS book_id, 'd' || doc_id || '.xhtml' AS href,
  list_prepend('Chapter ' || doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'), chr(10)), lambda x: {_squeeze('x')}), lambda x: x <> '')) AS ps FROM documents WHERE text IS NOT NULL)"""

PACK = """line AS (SELECT href, ps, unnest(range(1, len(ps) + 1)) AS i FROM sec),
sized AS (SELECT href, i, length(ps[i]) AS s FROM line),
pack(href, i, block, size) AS (SELECT href, i, 0, s FROM sized WHERE i = 1
  UNION ALL SELECT z.href, z.i, CASE WHEN p.size > 0 AND p.size + z.s > 12000 THEN p.block + 1 ELSE p.block END, CASE WHEN p.size > 0 AND p.size + z.s > 12000 THEN z.s ELSE p.size + z.s END FROM pack p JOIN sized z ON z.href = p.href AND z.i = p.i + 1)"""

ORACLES: dict[str, str] = {
    "shape_metrics": f"WITH {SEC}, {MET} SELECT doc_id, n AS n_paragraphs, progressive, " + ", ".join(f"round({c}, 4)::DECIMAL(18, 4) AS {c}" for c in (
        "mean_chars", "years", "citations", "numbers", "short"
    )) + " FROM met",
    "shape_votes": f"WITH {SEC}, {MET}, {SHAPE} SELECT href, role, weight FROM shape",
    "position_votes": f"WITH {SEC}, {POS} SELECT href, role, weight, confirms FROM position",
    "doc_verdicts": f"WITH {ALL_VERDICTS} SELECT doc_id, role, confidence, category FROM verdict_c",
    "category_coverage": f"WITH {ALL_VERDICTS}, c AS (SELECT book_id, category, sum(length(text))::BIGINT AS chars, count(*) AS documents FROM verdict_c GROUP BY book_id, category) SELECT *, {USE} AS use FROM c",
    "role_characters": f"WITH {ALL_VERDICTS} SELECT book_id, role, sum(length(text))::BIGINT AS chars, count(*) AS documents FROM verdict GROUP BY book_id, role",
    "quality_confusion": f"WITH {ALL_VERDICTS} SELECT quality, role, count(*) AS n FROM verdict JOIN labels USING (doc_id) GROUP BY quality, role",
    "title_roles": "WITH given(title, language) AS (VALUES " + ", ".join(f"({_q(t)}, {_q(lang)})" for t, lang in TITLES) + r"""),
head AS (SELECT DISTINCT * FROM (SELECT nullif("""
    + _untag(rf"regexp_extract({HTML}, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")
    + r""", '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*lang="([a-z-]+)"', 1), '') AS language FROM pages WHERE html IS NOT NULL UNION ALL SELECT title, language FROM given) WHERE title IS NOT NULL),
"""
    + _said("head", "title || chr(1) || coalesce(language, '')", "title", "language", "ttl")
    + " SELECT title, language, ttl.role AS role FROM head LEFT JOIN ttl ON ttl.key = title || chr(1) || coalesce(language, '')",
    "normalize_text": f"SELECT doc_id, {_norm('text')} AS normalized FROM documents WHERE text IS NOT NULL",
    "text_fingerprint": f"SELECT doc_id, substr(sha256({_fold(_squeeze('text'))}), 1, 24) AS fingerprint, substr(sha256(coalesce(source, 'None') || chr(0) || doc_id), 1, 24) AS joined_id FROM documents WHERE text IS NOT NULL",
    "duplicate_units": f"SELECT substr(sha256({_fold(_squeeze('text'))}), 1, 24) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "page_visible_text": f"SELECT page_id, {_untag(_hidden(HTML))} AS text FROM pages WHERE html IS NOT NULL",
    "page_paragraphs": rf"WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all({HTML}, '(?is)<p\b[^>]*>(.*?)</p\s*>', 1), lambda x: {_untag('x')}), lambda x: x <> '') AS ps FROM pages WHERE html IS NOT NULL) SELECT page_id, i - 1 AS pos, ps[i] AS paragraph FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p)",
    "page_toc_links": rf"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<nav\b.*?</nav\s*>')) AS nav FROM pages WHERE html IS NOT NULL),
l AS (SELECT page_id, regexp_extract_all(nav, '{LINK}', 1) AS hs, regexp_extract_all(nav, '{LINK}', 2) AS ts FROM n WHERE NOT contains(lower(regexp_extract(nav, '(?i)epub:type\s*=\s*["'']([^"'']+)["'']', 1)), 'landmarks')),
e AS (SELECT page_id, i, hs[i] AS href, {_untag('ts[i]')} AS title FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM l))
SELECT page_id, href, arg_min(title, i) AS title FROM e WHERE title <> '' GROUP BY page_id, href""",
    "page_headings": f"SELECT page_id, 1 AS level, h AS heading FROM (SELECT page_id, {_untag(_HEADING)} AS h FROM pages WHERE html IS NOT NULL) WHERE h <> ''",
    "href_resolve": r"""WITH e AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS base, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*href\s*=\s*["'']([^"'']+)["'']', 1)) AS href FROM pages WHERE html IS NOT NULL),
p AS (SELECT *, split_part(href, '#', 1) AS path, string_split(base, '/') AS bs FROM e)
SELECT page_id, href, CASE WHEN path = '' THEN base ELSE replace(url_decode(replace(array_to_string(list_filter(list_concat(bs[1:len(bs) - 1], string_split(path, '/')), lambda x: x NOT IN ('', '.')), '/'), '+', '%2B')), chr(0), '') END AS resolved FROM p""",
    "hard_sequences": f"WITH {_seq()} SELECT book_id, sequence_id, category, {USE} AS use, n_units, length(text) AS chars, sha256(text) AS text_sha256 FROM seq",
    "filtered_sequences": f"""WITH {_seq("category IN ('work_text', 'note')")} SELECT book_id, sequence_id, category, n_units, length(text) AS chars FROM seq""",
    "sequence_offsets": f"WITH {_seq()} SELECT sequence_id, unit_id, start, start + length(text) AS stop FROM (SELECT seq.sequence_id, run.unit_id, run.text, coalesce(sum(length(run.text) + 2) OVER (PARTITION BY run.book_id, run.run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM run JOIN seq ON seq.book_id = run.book_id AND seq.run = run.run)",
    "conversation_runs": """WITH t AS (SELECT *, coalesce(role <> lag(role) OVER w OR turn <> lag(turn) OVER w + 1, true) AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t) SELECT conv_id, run, role, count(*) AS turns, min(turn) AS first_turn, sum(length(text))::BIGINT AS chars FROM r GROUP BY conv_id, run, role""",
    "find_text": """WITH q AS (SELECT DISTINCT text AS query, lower(text) AS needle FROM benchmark WHERE coalesce(text, '') <> ''),
h AS (SELECT doc_id, text, query, length(query) AS n, string_split(lower(text), needle) AS parts FROM documents JOIN q ON contains(lower(text), needle)),
o AS (SELECT *, unnest(range(1, len(parts))) AS i FROM h),
s AS (SELECT *, list_sum(list_transform(parts[1:i], lambda p: length(p)))::BIGINT + (i - 1) * n AS start FROM o)
SELECT query, doc_id, start, start + n AS stop, trim(substr(text, start + 1, n)) AS text FROM s""",
    "token_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS tokens FROM documents WHERE text IS NOT NULL",
    "fixed_chunks": f"WITH {CHUNKED} SELECT sequence_id, chunk, least(t - chunk * 180, 200) AS tokens FROM chunk",
    "chunk_neighbours": f"WITH {CHUNKED} SELECT sequence_id, count(*) AS chunks, count(*) - 1 AS with_previous, count(*) - 1 AS with_next FROM chunk GROUP BY sequence_id",
    "chunk_interval_coverage": f"WITH {UNITS} SELECT book_id, sum(length(text))::BIGINT AS characters, sum(length(text))::BIGINT AS covered, 0 AS gap FROM unit GROUP BY book_id",
    "interval_merge": """WITH s AS (SELECT lang, doc_id * 1000 AS start, doc_id * 1000 + length(text) AS stop FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
r AS (SELECT *, max(stop) OVER (PARTITION BY lang ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(coalesce(start > reach, true)::INTEGER) OVER (PARTITION BY lang ORDER BY start, stop) AS island FROM r) SELECT lang, min(start) AS start, max(stop) AS stop FROM g GROUP BY lang, island""",
    "excerpts": f"WITH s AS (SELECT doc_id, {_squeeze('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE left(t, 60) || ' [...] ' || right(t, 60) END AS excerpt FROM s",
    "audit_batches": f"""WITH RECURSIVE d AS (SELECT {BOOK} AS book_id, doc_id, length(text) AS s, row_number() OVER (PARTITION BY {BOOK} ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
b(book_id, doc_id, i, batch, items, size) AS (SELECT book_id, doc_id, i, 0, 1, s FROM d WHERE i = 1
  UNION ALL SELECT d.book_id, d.doc_id, d.i, CASE WHEN b.items >= 18 OR b.size + d.s > 24000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.items >= 18 OR b.size + d.s > 24000 THEN 1 ELSE b.items + 1 END, CASE WHEN b.items >= 18 OR b.size + d.s > 24000 THEN d.s ELSE b.size + d.s END FROM b JOIN d ON d.book_id = b.book_id AND d.i = b.i + 1)
SELECT book_id, doc_id, batch FROM b""",
    "packed_blocks": f"WITH RECURSIVE {SEC}, {PACK} SELECT href, i - 1 AS atom, block AS block_index FROM pack",
    "line_blocks": f"""WITH RECURSIVE {SEC}, {PACK},
b AS (SELECT pack.href, block, min(pack.i) AS first, count(*) AS elements, string_agg(ps[pack.i], ' ' ORDER BY pack.i) AS text FROM pack JOIN line ON line.href = pack.href AND line.i = pack.i GROUP BY pack.href, block)
SELECT href, block AS block_index, substr(sha256(href || chr(0) || '/p[' || first || ']' || chr(0) || left(text, 200)), 1, 20) AS block_id, length(text) AS chars, elements, substr(sha256({_fold(_squeeze('text'))}), 1, 20) AS fingerprint, elements AS fragments FROM b""",
    "lexical_flags": f"""WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, {_norm('ls[i]')} AS norm FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE trim(ls[i]) <> ''),
f AS (SELECT doc_id, pos, {FLAGS} FROM l)
SELECT * FROM f WHERE legal OR promotion OR credits OR licence OR backlist OR contents OR dedication""",
    # Blocks of plain lines: no titles, markers, links or declarations, so most rules cannot hold here; rule_cases has those.
    "rule_cascade": f"""WITH RECURSIVE {ALL_VERDICTS}, {PACK},
b0 AS (SELECT pack.href, block AS block_index, count(*) AS elements, string_agg(ps[pack.i], ' ' ORDER BY pack.i) AS line FROM pack JOIN line ON line.href = pack.href AND line.i = pack.i GROUP BY pack.href, block),
b1 AS (SELECT *, {_norm('line')} AS norm, length(line) AS chars, len(regexp_extract_all(line, '[.!?…](?:{_WS}|$)')) AS sentences FROM b0),
b2 AS (SELECT *, {FLAGS} FROM b1),
dv AS (SELECT v.doc_id, v.book_id, v.role, v.confidence, sec.href, sec.spine_index, length(sec.text) AS d_chars, sec.text AS d_text, shape.role = 'analytic_index' AS looks_index,
              sec.spine_index / greatest(1, count(*) OVER (PARTITION BY v.book_id) - 1) AS p_spine FROM verdict v JOIN sec ON sec.doc_id = v.doc_id LEFT JOIN shape ON shape.doc_id = v.doc_id),
nb AS (SELECT *, lag(role) OVER w IN ('body', 'threshold', 'appendix') AS after_text, lead(role) OVER w IN ('body', 'threshold', 'appendix') AS before_text,
              CASE WHEN length(lag(d_text) OVER w) <= 200 THEN trim({_norm('lag(d_text) OVER w')}) END AS before FROM dv WINDOW w AS (PARTITION BY book_id ORDER BY spine_index)),
x AS (SELECT nb.*, b2.* EXCLUDE (href), chars / greatest(1, elements) AS density, count(*) OVER (PARTITION BY nb.book_id, nb.href) AS d_blocks, max(chars) OVER (PARTITION BY nb.book_id, nb.href) AS longest,
             (row_number() OVER (PARTITION BY nb.book_id ORDER BY spine_index, block_index) - 1) / greatest(1, count(*) OVER (PARTITION BY nb.book_id) - 1) AS p FROM nb JOIN b2 ON b2.href = nb.href),
r AS (SELECT *, CASE
  WHEN legal AND (p <= 0.12 OR p >= 0.88) AND chars <= 4000 THEN 'marginal-legal-matter' WHEN backlist AND p >= 0.88 AND chars <= 20000 THEN 'publisher-backlist'
  WHEN credits AND p >= 0.88 AND chars <= 4000 THEN 'editorial-credits' WHEN licence AND p >= 0.88 AND chars <= 4000 THEN 'end-user-licence' WHEN promotion AND p >= 0.88 AND chars <= 4000 THEN 'publisher-promotion'
  WHEN role = 'paratext' AND d_blocks <= 3 AND d_chars <= 300 AND longest <= 120 AND chars <= 120 AND (trim(norm) = '' OR p BETWEEN 0.08 AND 0.92) AND (coalesce(after_text, false) OR coalesce(before_text, false)) THEN 'narrative-divider'
  WHEN d_blocks = 1 AND list_contains([{", ".join(_q(normal(h).strip()) for h in V.AUTHOR_HEADINGS)}], before) THEN 'continued-author-biography'
  WHEN role = 'paratext' AND p_spine <= 0.08 AND chars BETWEEN 450 AND 3000 AND elements >= 4 AND sentences >= 3 AND coalesce(before_text, false) AND NOT legal AND NOT backlist AND NOT credits THEN 'composite-textual-opening'
  WHEN role = 'uncertain' AND p_spine BETWEEN 0.12 AND 0.92 AND chars BETWEEN 600 AND 1500 AND density >= 120 AND NOT credits THEN 'unmarked-internal-prose'
  WHEN role = 'analytic_index' AND looks_index AND chars >= 800 AND density >= 300 THEN 'weak-index-not-propagated' ELSE 'document-role-inheritance' END AS rule_id FROM x),
z AS (SELECT href, block_index, rule_id, dedication, credits, CASE WHEN rule_id IN ('narrative-divider', 'composite-textual-opening', 'unmarked-internal-prose', 'weak-index-not-propagated') THEN 'body' WHEN rule_id = 'document-role-inheritance' THEN role ELSE 'paratext' END AS role,
  CASE rule_id WHEN 'narrative-divider' THEN 0.9 WHEN 'composite-textual-opening' THEN 0.8 WHEN 'unmarked-internal-prose' THEN 0.65 WHEN 'weak-index-not-propagated' THEN 0.65 WHEN 'end-user-licence' THEN 0.99 WHEN 'publisher-promotion' THEN 0.95
    WHEN 'document-role-inheritance' THEN least(0.75, greatest(0.2, confidence)) ELSE 0.98 END AS confidence FROM r),
k AS (SELECT *, CASE WHEN role = 'paratext' AND dedication AND NOT credits THEN 'work_text' WHEN role IN ('note', 'bibliography', 'paratext') THEN role WHEN role IN ('analytic_index', 'contents') THEN 'index' ELSE 'work_text' END AS category FROM z)
SELECT href, block_index, rule_id, role, confidence::DECIMAL(6,3) AS confidence, category, {USE} AS use FROM k""",
    "block_features": f"""WITH RECURSIVE {ALL_VERDICTS}, {PACK},
b AS (SELECT pack.href, block AS block_index, count(*) AS elements, string_agg(ps[pack.i], ' ' ORDER BY pack.i) AS text FROM pack JOIN line ON line.href = pack.href AND line.i = pack.i GROUP BY pack.href, block),
vt AS (SELECT doc_id, list('signal_' || signal || '=' || role || CASE WHEN confirms THEN ':confirms' ELSE '' END) AS said
       FROM (SELECT doc_id, 'shape' AS signal, role, false AS confirms FROM shape UNION ALL SELECT doc_id, 'position', role, confirms FROM position) GROUP BY doc_id),
x AS (SELECT b.*, sec.book_id, sec.spine_index, length(b.text) AS chars, v.role, coalesce(vt.said, []) AS said,
             sec.spine_index / greatest(1, (SELECT count(*) FROM sec s2 WHERE s2.book_id = sec.book_id) - 1) AS p_spine, len(regexp_extract_all(b.text, '[\\p{{L}}\\p{{N}}_]+')) AS words
      FROM b JOIN sec ON sec.href = b.href JOIN verdict v ON v.doc_id = sec.doc_id LEFT JOIN vt ON vt.doc_id = sec.doc_id),
y AS (SELECT *, (row_number() OVER r - 1) / greatest(1, count(*) OVER (PARTITION BY book_id) - 1) AS p_book, block_index / greatest(1, max(block_index) OVER (PARTITION BY href)) AS p_doc,
             lag(href) OVER r AS before, lead(href) OVER r AS after FROM x WINDOW r AS (PARTITION BY book_id ORDER BY spine_index, block_index))
SELECT href, block_index, round(least(1.5, ln(1 + chars) / 9.5), 4)::DECIMAL(9,4) AS log_characters, round(least(1.5, ln(1 + elements) / 5.0), 4)::DECIMAL(9,4) AS log_elements,
  round(p_doc, 4)::DECIMAL(9,4) AS document_position, round(p_book, 4)::DECIMAL(9,4) AS book_position, round(p_spine, 4)::DECIMAL(9,4) AS spine_position, 0::DECIMAL(9,4) AS link_density, 0::DECIMAL(9,4) AS image_density,
  round(least(1.5, len(regexp_extract_all(text, '\\p{{Nd}}')) / greatest(1, chars) * 12), 4)::DECIMAL(9,4) AS digit_density,
  round(least(1.5, len(regexp_extract_all(text, '\\b(?:1[5-9][0-9]{{2}}|20[0-4][0-9])\\b')) / elements), 4)::DECIMAL(9,4) AS years_per_element,
  round(least(1.5, len(regexp_extract_all(text, '(?i)\\b(?:cfr|ibid|ibidem|op\\. cit|art\\. cit|vol|pp|p\\.|ed\\.|trad|a cura di|works cited|references)\\b')) / elements), 4)::DECIMAL(9,4) AS citations_per_element,
  round(least(1.0, len(regexp_extract_all(text, '\\p{{Lu}}')) / greatest(1, len(regexp_extract_all(text, '\\p{{L}}')))), 4)::DECIMAL(9,4) AS uppercase_share, 0::DECIMAL(9,4) AS has_title, 0::DECIMAL(9,4) AS non_linear,
  CASE WHEN regexp_matches(text, '^\\s*\\[?[0-9]{{1,4}}[\\].)\\s]') THEN 1 ELSE 0 END::DECIMAL(9,4) AS starts_with_number,
  CASE WHEN before IS NOT NULL THEN (before = href)::INTEGER END::DECIMAL(9,4) AS same_document_previous, CASE WHEN after IS NOT NULL THEN (after = href)::INTEGER END::DECIMAL(9,4) AS same_document_next,
  array_to_string(list_sort(list_distinct(list_filter(list_concat(said, ['document_role=' || role, 'language=?', 'shape=prose', CASE WHEN before IS NOT NULL THEN 'previous_shape=prose' END, CASE WHEN after IS NOT NULL THEN 'next_shape=prose' END,
    'position_zone=' || CASE WHEN p_spine <= 0.1 THEN 'start' WHEN p_spine >= 0.88 THEN 'end' ELSE 'middle' END]), lambda x: x IS NOT NULL))), ' ') AS named FROM y""",
    "semantic_chunks": f"""WITH RECURSIVE {_seq()},
u AS (SELECT book_id, run, sum(len(regexp_extract_all(text, '{TOKEN}'))) OVER (PARTITION BY book_id, run ORDER BY ord) AS stop FROM run),
s AS (SELECT sequence_id, list(stop ORDER BY stop) AS ends, max(stop)::BIGINT AS total FROM u JOIN seq USING (book_id, run) GROUP BY sequence_id),
cut(sequence_id, chunk, first, last) AS (
  SELECT sequence_id, 0, 0::BIGINT, CASE WHEN total <= 200 THEN total ELSE coalesce(list_max(list_filter(ends, lambda x: x BETWEEN 50 AND 200)), 200) END::BIGINT FROM s WHERE total > 0
  UNION ALL SELECT n.sequence_id, n.chunk, n.first, CASE WHEN s.total - n.first <= 200 THEN s.total ELSE greatest(n.first + 1, coalesce(list_max(list_filter(s.ends, lambda x: x BETWEEN n.first + 50 AND n.first + 200)), n.first + 200)) END::BIGINT
    FROM (SELECT cut.sequence_id, chunk + 1 AS chunk, greatest(cut.first + 1, cut.last - 20) AS first, cut.last FROM cut) n JOIN s ON s.sequence_id = n.sequence_id WHERE n.last < s.total)
SELECT sequence_id, chunk, last - first AS tokens FROM cut""",
    "epub_blocks": f"""WITH RECURSIVE {EPUB_SEC}, {PACK},
b AS (SELECT pack.href, block, string_agg(ps[pack.i], ' ' ORDER BY pack.i) AS text FROM pack JOIN line ON line.href = pack.href AND line.i = pack.i GROUP BY pack.href, block)
SELECT book_id AS book, b.href, block AS "order", CASE WHEN block = 0 THEN 'section' ELSE 'prose' END AS shape, length(b.text) AS chars, 'work_text' AS category, 'block-title-role' AS classification_rule FROM b JOIN sec ON sec.href = b.href""",
    "epub_coverage": f"""WITH RECURSIVE {EPUB_SEC}, {PACK},
b AS (SELECT pack.href, block, string_agg(ps[pack.i], ' ' ORDER BY pack.i) AS text FROM pack JOIN line ON line.href = pack.href AND line.i = pack.i GROUP BY pack.href, block),
c AS (SELECT book_id, sum(length(b.text))::BIGINT AS classified FROM b JOIN sec ON sec.href = b.href GROUP BY book_id),
v AS (SELECT book_id, sum(length(array_to_string(ps, ' ')))::BIGINT AS visible FROM sec GROUP BY book_id)
SELECT book_id AS book, visible, classified, classified AS main, 0 AS notes, 0 AS excluded, true AS valid FROM c JOIN v USING (book_id)""",
    "chunk_contexts": f"""WITH {CHUNKED}, c AS (SELECT sequence_id, chunk, t, chunk * 180 AS a, least(t, chunk * 180 + 200) AS b FROM chunk),
d AS (SELECT *, greatest(0, 400 - (b - a)) AS extra FROM c), e AS (SELECT *, least(a, extra // 2) AS half FROM d), f AS (SELECT *, least(t - b, extra - half) AS behind FROM e)
SELECT sequence_id, chunk, (b + behind) - (a - half - least(a - half, extra - half - behind)) AS tokens FROM f""",
    "calibrated_temperature": f"""WITH {SEC}, {MET}, f AS (SELECT doc_id, least(1.5, length(text) / 5000) AS l, least(1.5, short) AS s, least(1.5, numbers) AS m, least(1.5, n / 20) AS p FROM met),
z AS (SELECT doc_id, 0 AS r, 0.1 + 1.2 * l - 0.7 * s AS v FROM f UNION ALL SELECT doc_id, 1, -0.2 + 0.9 * s + 0.4 * m FROM f UNION ALL SELECT doc_id, 2, 0.0 - 1.1 * p FROM f),
e AS (SELECT doc_id, r, t / 20 AS t, exp(v / (t / 20)) AS x FROM z, range(10, 61) g(t)),
q AS (SELECT t, avg(-ln(own / x)) AS loss FROM (SELECT doc_id, t, sum(x) AS x, max(CASE WHEN r = doc_id % 3 THEN x END) AS own FROM e GROUP BY doc_id, t) GROUP BY t)
SELECT arg_min(t, loss)::DOUBLE AS temperature FROM q""",
    "finding_cases": f"""WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
h AS (SELECT *, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS h FROM i),
f AS (SELECT l_orderkey, {", ".join(f"([{', '.join('NULL' if x is None else _q(x) if isinstance(x, str) else str(x) for x in v)}])[('0x' || substr(h, {2 * k + 1}, 2))::INTEGER % {len(v)} + 1] AS {n}" for k, (n, v) in enumerate(FINDING_FIELDS.items()))} FROM h),
g AS (SELECT *, CASE WHEN scope = 'document' THEN CASE href WHEN 'd0' THEN 'note' WHEN 'd2' THEN 'paratext' END
                     WHEN scope = 'block' THEN CASE href || block_id WHEN 'd0b0' THEN 'note' WHEN 'd1b1' THEN 'work_text' WHEN 'd1b0' THEN 'paratext' END END AS current FROM f),
r AS (SELECT *, CASE WHEN confidence IS NULL THEN 'confidence must be numeric' WHEN kind = 'praise' THEN 'invalid kind'
  WHEN NOT (scope = 'document' OR scope = CASE WHEN l_orderkey % 2 = 0 THEN 'block' ELSE 'book' END) THEN 'invalid scope' WHEN severity = 'fatal' THEN 'invalid severity'
  WHEN confidence > 1 THEN 'confidence must be between 0 and 1' WHEN explanation = '' THEN 'explanation cannot be empty' WHEN evidence = 'broken' THEN 'evidence must be a list of strings'
  WHEN category = 'poem' THEN 'invalid proposed category' WHEN scope = 'book' AND (href <> '' OR block_id <> '') THEN 'a finding on the book cannot name a document or block'
  WHEN scope = 'document' AND (href NOT IN ('d0', 'd1', 'd2') OR block_id <> '') THEN 'no such document' WHEN scope = 'block' AND current IS NULL THEN 'no such block'
  WHEN kind = 'category_change' AND (scope = 'book' OR category = '') THEN 'a category change needs a document or block and a category'
  WHEN kind = 'category_change' AND category = current THEN 'a category change must change the category' END AS reason FROM g),
k AS (SELECT DISTINCT kind, scope, href, block_id, category, trim(explanation) AS explanation, current FROM r WHERE reason IS NULL)
SELECT 'issue' AS what, reason, '' AS kind, '' AS scope, NULL AS current, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'finding', CASE WHEN kind = 'category_change' AND scope <> 'book' THEN 'can override' ELSE 'cannot' END AS why, kind, scope, current, count(*) FROM k GROUP BY why, kind, scope, current""",
    # Every chunk's anchor leads back to its text, so what is counted is chunks of up to 350 tokens, with element ends.
    "verify_sources": f"""WITH RECURSIVE {EPUB_SEC},
atom AS (SELECT href, unnest(range(1, len(ps) + 1)) AS i, ps FROM sec), size AS (SELECT href, i, sum(len(regexp_extract_all(ps[i], '{TOKEN}'))) OVER (PARTITION BY href ORDER BY i)::BIGINT AS stop FROM atom),
s AS (SELECT href, list(stop ORDER BY i) AS ends, max(stop) AS total FROM size GROUP BY href),
cut(href, first, last) AS (
  SELECT href, 0::BIGINT, CASE WHEN total <= 350 THEN total ELSE coalesce(list_max(list_filter(ends, lambda x: x BETWEEN 80 AND 350)), 350) END::BIGINT FROM s
  UNION ALL SELECT w.href, w.first, CASE WHEN s.total - w.first <= 350 THEN s.total ELSE greatest(w.first + 1, coalesce(list_max(list_filter(s.ends, lambda x: x BETWEEN w.first + 80 AND w.first + 350)), w.first + 350)) END::BIGINT
    FROM (SELECT cut.href, greatest(cut.first + 1, cut.last - 40) AS first, cut.last FROM cut) w JOIN s ON s.href = w.href WHERE w.last < s.total)
SELECT true AS verified, count(*) AS n FROM cut""",
    # A profile with one wrong fingerprint is rejected as a whole; else a block's correction goes before its document's.
    "profile_precedence": f"""WITH {ALL_VERDICTS}, lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT v.doc_id, v.book_id, v.category, v.confidence, length(v.text) AS chars, quality, toxic FROM verdict_c v LEFT JOIN lab USING (doc_id)),
shut AS (SELECT DISTINCT book_id FROM v WHERE quality = 0 AND doc_id % 23 = 5),
w AS (SELECT v.*, shut.book_id IS NULL AS good, CASE WHEN quality = 0 THEN 'paratext' WHEN toxic = 1 THEN 'note' END AS said FROM v LEFT JOIN shut USING (book_id)),
x AS (SELECT doc_id, good AND said IS NOT NULL AS changed, CASE WHEN good AND said IS NOT NULL THEN said ELSE category END AS category, confidence, good AND quality = 1 AND chars >= 40 AS cut FROM w)
SELECT doc_id, category, {USE} AS use, (CASE WHEN changed THEN 1 ELSE confidence END)::DECIMAL(6,3) AS confidence, CASE WHEN changed THEN 'edition_profile' ELSE 'classifier' END AS source, coalesce(cut, false)::INTEGER AS ranges FROM x""",
    "profile_faults": """WITH says(k, reason) AS (VALUES (1, 'unsupported schema'), (2, 'unsupported category policy version'), (3, 'book.sha256 must contain 64 hexadecimal characters'),
  (4, 'unsupported category: poem'), (5, 'unsupported category: null'), (6, 'href must be a non-empty string'), (7, 'block_id must be a non-empty string'), (8, 'fingerprint must be a non-empty string'),
  (9, 'text_fingerprint must be a non-empty string'), (10, 'invalid range bounds'), (11, 'invalid range bounds'), (12, 'invalid range bounds'), (13, 'duplicate document override: h1'),
  (14, 'duplicate block override: h1#b1'), (15, 'duplicate range override: r1'), (16, 'overlapping range overrides: h1#b1'))
SELECT DISTINCT s_suppkey::VARCHAR AS profile, reason FROM supplier JOIN says ON k = s_suppkey % 17""",
    "range_split": f"""WITH {UNITS}, p AS (SELECT *, unnest(CASE WHEN length(text) < 100 THEN [[0, length(text), 0]] ELSE list_filter([[0, 10, 0], [10, 30, 1], [30, 60, 0], [60, 90, 2], [90, length(text), 0]], lambda x: x[1] < x[2]) END) AS c FROM unit)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY ord, c[1]) - 1 AS "order", unit_id AS block_id, CASE c[3] WHEN 1 THEN 'note' WHEN 2 THEN 'index' ELSE category END AS category, substr(text, c[1] + 1, c[2] - c[1]) AS text FROM p""",
    "range_overlap_violations": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS start, l_partkey + l_quantity::BIGINT AS "end" FROM lineitem),
m AS (SELECT *, max("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end", l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) SELECT l_orderkey, l_linenumber, start, "end" FROM m WHERE start < reach""",
    "reciprocal_pairs": f"WITH {ARCS}, o AS (SELECT DISTINCT book_id, src AS href, src_id, dst_id FROM arc WHERE src = dst AND src_id <> dst_id) SELECT o.book_id, o.href, o.src_id AS a, o.dst_id AS b FROM o JOIN o r ON r.book_id = o.book_id AND r.href = o.href AND r.src_id = o.dst_id AND r.dst_id = o.src_id WHERE o.src_id < o.dst_id",
    "mutual_anchors": f"WITH {ARCS}, o AS (SELECT DISTINCT * FROM arc WHERE src <> dst) SELECT o.book_id, o.src AS src_href, o.dst AS dst_href, count(*) AS pairs FROM o JOIN o r ON r.book_id = o.book_id AND r.src = o.dst AND r.dst = o.src AND r.src_id = o.dst_id AND r.dst_id = o.src_id GROUP BY 1, 2, 3",
    "note_graph_votes": f"""WITH {ARCS}, o AS (SELECT DISTINCT * FROM arc WHERE src <> dst), e AS (SELECT DISTINCT book_id, src, dst FROM o),
pr AS (SELECT o.book_id, o.src, o.dst, count(*) AS pairs FROM o JOIN o r ON r.book_id = o.book_id AND r.src = o.dst AND r.dst = o.src AND r.src_id = o.dst_id AND r.dst_id = o.src_id GROUP BY 1, 2, 3),
x AS (SELECT e.*, r.book_id IS NOT NULL AS returned, coalesce(pairs, 0) AS pairs, 100 + 50 * e.src::INTEGER AS sc, 100 + 50 * e.dst::INTEGER AS dc FROM e LEFT JOIN e r ON r.book_id = e.book_id AND r.src = e.dst AND r.dst = e.src LEFT JOIN pr ON pr.book_id = e.book_id AND pr.src = e.src AND pr.dst = e.dst),
s AS (SELECT book_id, dst, count(*) AS n, count_if(returned) AS back, sum(pairs) AS pairs, min(pairs) AS least, sum(sc) AS sc, any_value(dc) AS dc FROM x GROUP BY book_id, dst),
v AS (SELECT *, CASE WHEN n >= 3 THEN CASE WHEN back >= greatest(2, ceil(n * 0.6::DOUBLE)) THEN CASE WHEN n >= 8 THEN 3.5 ELSE 2.5 END END
                WHEN pairs >= 4 AND least > 0 AND dc < sc AND pairs / dc >= pairs / sc * 1.5 THEN 2.5 END::DOUBLE AS weight FROM s),
i AS (SELECT o.book_id, o.href, count(*) AS n FROM (SELECT DISTINCT book_id, src AS href, src_id, dst_id FROM arc WHERE src = dst AND src_id < dst_id) o JOIN (SELECT DISTINCT book_id, src AS href, src_id, dst_id FROM arc WHERE src = dst) r ON r.book_id = o.book_id AND r.href = o.href AND r.src_id = o.dst_id AND r.dst_id = o.src_id GROUP BY 1, 2),
a AS (SELECT book_id, dst AS href, 'note' AS role, weight FROM v WHERE weight IS NOT NULL UNION ALL SELECT x.book_id, x.src, 'body', 0.8 FROM x JOIN v ON v.book_id = x.book_id AND v.dst = x.dst WHERE v.weight IS NOT NULL UNION ALL SELECT book_id, href, 'body', 1.2 FROM i WHERE n >= 4)
SELECT book_id, href, role, count(*) AS votes, round(sum(weight), 4) AS weight FROM a GROUP BY book_id, href, role""",
    "template_families": f"""WITH RECURSIVE d AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '{_WS}+', ' ', 'g'), ' '), lambda w: w <> '')) AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS same FROM d WHERE len(t) > 0), one AS (SELECT min(doc_id) AS doc_id, same, any_value(n) AS n FROM h GROUP BY same),
k AS (SELECT one.doc_id, one.n, unnest(t) AS token FROM one JOIN d USING (doc_id)), c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS n FROM k x JOIN k y ON x.token = y.token AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.72 * greatest(x.n, y.n) GROUP BY 1, 2, 3, 4),
p AS (SELECT a, b FROM c WHERE n / (na + nb - n) >= 0.72),
g AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT doc_id, doc_id FROM one),
r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
f AS (SELECT a, min(b) AS family FROM r GROUP BY a)
SELECT h.doc_id, 'fam-' || lpad(family::VARCHAR, 12, '0') AS family FROM h JOIN one USING (same) JOIN f ON f.a = one.doc_id""",
    "softmax_scores": f"""WITH {SEC}, {MET}, f AS (SELECT doc_id, least(1.5, length(text) / 5000) AS l, least(1.5, short) AS s, least(1.5, numbers) AS m, least(1.5, n / 20) AS p FROM met),
z AS (SELECT doc_id, 'body' AS role, (0.1 + 1.2 * l - 0.7 * s) / 1.3 AS v FROM f UNION ALL SELECT doc_id, 'note', (-0.2 + 0.9 * s + 0.4 * m) / 1.3 FROM f UNION ALL SELECT doc_id, 'paratext', (0.0 - 1.1 * p) / 1.3 FROM f),
e AS (SELECT doc_id, role, exp(v) / sum(exp(v)) OVER (PARTITION BY doc_id) AS p FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, role) AS i FROM e)
SELECT doc_id, role, round(p, 6)::DECIMAL(9, 6) AS probability FROM k WHERE i = 1""",
    "review_merge": """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT doc_id::VARCHAR AS href, CASE WHEN toxic = 1 THEN 'note' ELSE 'paratext' END AS label, CASE WHEN toxic = 1 THEN 'by hand' ELSE 'low quality' END AS note, CASE WHEN toxic = 1 THEN '2023-12-31' ELSE '2024-01-02' END AS updated_at FROM l WHERE quality = 0 OR toxic = 1""",
    "profile_payloads": "SELECT coalesce(source, '') AS book_id, count_if(coalesce(toxic, 0) <> 1) AS documents, count_if(toxic = 1) AS ignored, 1 AS policy FROM documents JOIN labels USING (doc_id) GROUP BY 1",
}
