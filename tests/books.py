"""EPUB files made for tests."""

from __future__ import annotations

import io
import zipfile

XHTML = '<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>hidden</title><style>p {{}}</style></head><body{attrs}>{body}</body></html>'
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
PROSE = "The harbour lay quiet that morning, and no one spoke of the ship that had not come back. She counted the masts again and wrote the number down. "


def page(body: str, attrs: str = "") -> str:
    return XHTML.format(body=body, attrs=attrs)


def chapter(n: int, times: int = 20) -> str:
    return page(f"<h1>Chapter {n}</h1>" + "".join(f"<p>{PROSE}{n}.{i} {PROSE}{PROSE}</p>" for i in range(times)))


class FixedZip(zipfile.ZipFile):
    """Members without the time of writing, so equal books are equal files."""

    def writestr(self, name, data, **more):
        super().writestr(zipfile.ZipInfo(name), data, **more)


def epub(
    documents: dict[str, str], *, title: str = "The Harbour", language: str = "en", metadata: str = "", nav: dict[str, str] | None = None,
    landmarks: dict[str, str] | None = None, nonlinear: tuple[str, ...] = (), extra: dict[str, str] | None = None, spine: list[str] | None = None
) -> bytes:
    """documents: file name to XHTML, in reading order; nav: file name to title."""
    out = io.BytesIO()
    with FixedZip(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", CONTAINER)
        items = "".join(f'<item id="i{n}" href="{name}" media-type="application/xhtml+xml"/>' for n, name in enumerate(documents))
        if nav is not None or landmarks:
            toc = "".join(f'<li><a href="{h}">{t}</a></li>' for h, t in (nav or {}).items())
            marks = "".join(f'<li><a epub:type="{r}" href="{h}">x</a></li>' for r, h in (landmarks or {}).items())
            items += '<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>'
            z.writestr("OEBPS/nav.xhtml", page(f'<nav epub:type="toc"><ol>{toc}</ol></nav><nav epub:type="landmarks"><ol>{marks}</ol></nav>'))
        order = spine if spine is not None else list(documents)
        refs = "".join(
            f'<itemref idref="i{list(documents).index(n) if n in documents else n}"{" linear=" + chr(34) + "no" + chr(34) if n in nonlinear else ""}/>' for n in order
        )
        z.writestr(
            "OEBPS/content.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf" version="3.0"><metadata><dc:title>{title}</dc:title><dc:language>{language}</dc:language>{metadata}</metadata><manifest>{items}</manifest><spine>{refs}</spine></package>',
        )
        for name, text in documents.items():
            z.writestr(f"OEBPS/{name}", text)
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


def harbour() -> bytes:
    """Title page, five chapters, notes, bibliography, copyright page."""
    notes = "".join(f'<p id="n{i}"><a href="c{i}.xhtml#r{i}">{i}</a>. A short remark about chapter {i}.</p>' for i in range(1, 6))
    docs = {"title.xhtml": page("<h1>The Harbour</h1>")}
    docs |= {f"c{i}.xhtml": chapter(i).replace("</body>", f'<p>See <a id="r{i}" href="notes.xhtml#n{i}">{i}</a>.</p></body>') for i in range(1, 6)}
    docs["notes.xhtml"] = page(f"<h1>Notes</h1>{notes}")
    docs["works.xhtml"] = page("<h1>Bibliography</h1>" + "".join(f"<p>Smith, J., Harbours {i}, cfr. p. {i}, London 19{10 + i}.</p>" for i in range(12)))
    docs["rights.xhtml"] = page("<p>Copyright 2020 Harbour Press. All rights reserved. ISBN 1234567890.</p>")
    creators = '<dc:creator id="a" opf:role="aut" opf:file-as="Doe, Jane">Jane Doe</dc:creator><dc:creator id="t">Tom Roe</dc:creator><meta refines="#t" property="role">trl</meta><dc:date>2019-05-02</dc:date><dc:publisher>Harbour Press</dc:publisher>'
    return epub(docs, metadata=creators, nav={f"c{i}.xhtml": f"Chapter {i}" for i in range(1, 6)})
