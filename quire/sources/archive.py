"""Members of a ZIP archive under a policy: the directory becomes rows, rules over the rows say what is wrong with it.

Nothing is decompressed before the directory has passed. Content is read in pieces and counted as it comes, so that what an
archive claims about itself is never trusted.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from typing import NamedTuple
from urllib.parse import unquote, urlsplit
from xml import sax
from xml.etree import ElementTree

PIECE = 1 << 16
# The two ways in which fonts, and only fonts, may be obfuscated.
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
FONT_SUFFIXES = (".otf", ".ttf", ".woff", ".woff2")
ENCRYPTION = "META-INF/encryption.xml"


@dataclass(frozen=True)
class Limits:
    """Bounds on what is read of one archive. Only members that the reader needs are decompressed and count."""

    max_members: int = 20_000
    max_member_bytes: int = 32 * 1024 * 1024
    max_total_read_bytes: int = 256 * 1024 * 1024
    max_xml_elements: int = 250_000
    max_xml_depth: int = 256
    max_path_characters: int = 1_024

    def __post_init__(self):
        wrong = [f.name for f in fields(self) if type(getattr(self, f.name)) is not int or getattr(self, f.name) <= 0]
        if wrong:
            raise ValueError(f"whole numbers above 0 are needed for {', '.join(wrong)}")


class UnsafeArchive(ValueError):
    """An archive breaks a limit or the policy."""


class Member(NamedTuple):
    name: str
    size: int  # as the directory has it
    folder: bool
    locked: bool  # needs a password
    times: int  # rows of the directory with this name


def directory(zipped: zipfile.ZipFile) -> list[Member]:
    entries = zipped.infolist()
    times = Counter(e.filename for e in entries)
    return [Member(e.filename, e.file_size, e.is_dir(), bool(e.flag_bits & 1), times[e.filename]) for e in entries]


#: What must not be true of a row, and how to say so.
RULES: tuple[tuple[str, Callable[[Member, Limits], bool]], ...] = (
    ("its member path is too long", lambda m, limits: len(m.name) > limits.max_path_characters),
    ("its member path leads out of the archive", lambda m, _: bool(re.search(r"(?:^|/)\.\.(?:/|$)|^/|^[A-Za-z]:", m.name))),
    ("its member path is no portable name", lambda m, _: not m.name or "\\" in m.name or "\0" in m.name),
    ("the name occurs more than once", lambda m, _: m.times > 1),
    ("it is encrypted with a password", lambda m, _: m.locked),
)


def violations(rows: list[Member], limits: Limits) -> Iterator[str]:
    """What is wrong with a directory, in the order of its rows."""
    if len(rows) > limits.max_members:
        yield f"{len(rows)} members, more than the {limits.max_members} allowed"
    for row in rows:
        yield from (f"{row.name[:200]!r}: {says}" for says, broken in RULES if broken(row, limits))


def too_deep(name: str, levels: int, limits: Limits) -> None:
    if levels > limits.max_xml_depth:
        raise UnsafeArchive(f"{name!r} has more than {limits.max_xml_depth} levels of depth")


class _Shape(sax.ContentHandler):
    """Counts elements, stops a document that has too many, and notes how deep they are nested."""

    def __init__(self, name: str, limits: Limits):
        super().__init__()
        self.name, self.limits, self.elements, self.open, self.deepest = name, limits, 0, 0, 0

    def startElement(self, *_):
        self.elements, self.open = self.elements + 1, self.open + 1
        self.deepest = max(self.deepest, self.open)
        if self.elements > self.limits.max_xml_elements:
            raise UnsafeArchive(f"{self.name!r} has more than {self.limits.max_xml_elements} elements")

    def endElement(self, _):
        self.open -= 1


class Archive:
    """Reads members by name, within the limits; a member that was read is kept."""

    def __init__(self, content: bytes, limits: Limits):
        self.limits, self.zipped = limits, zipfile.ZipFile(io.BytesIO(content))
        rows = directory(self.zipped)
        if says := next(violations(rows, limits), None):
            raise UnsafeArchive(says)
        self.members = {m.name: m for m in rows}
        self.left = limits.max_total_read_bytes
        self.kept: dict[str, bytes] = {}
        self.sound: set[str] = set()

    def has(self, name: str) -> bool:
        return name in self.members and not self.members[name].folder

    def bytes(self, name: str) -> bytes:
        """KeyError if there is no such file."""
        if not self.has(name):
            raise KeyError(name)
        if name not in self.kept:
            self.kept[name] = b"".join(self._pieces(self.members[name]))
        return self.kept[name]

    def _pieces(self, member: Member) -> Iterator[bytes]:
        room = self.limits.max_member_bytes
        if member.size > room:
            raise UnsafeArchive(f"{member.name!r} advertises {member.size} bytes, more than the {room} allowed")
        try:
            with self.zipped.open(member.name) as stream:
                while piece := stream.read(PIECE):
                    room, self.left = room - len(piece), self.left - len(piece)
                    if room < 0:
                        raise UnsafeArchive(f"{member.name!r} holds more than the {self.limits.max_member_bytes} bytes allowed")
                    if self.left < 0:
                        raise UnsafeArchive(f"total decompressed content passes {self.limits.max_total_read_bytes} bytes")
                    yield piece
        except (RuntimeError, zipfile.BadZipFile, OSError, EOFError) as error:
            raise UnsafeArchive(f"{member.name!r} does not decompress: {error}") from error

    def xml(self, name: str) -> bytes:
        """A member whose elements were counted before anything builds a tree of them. It need not be well-formed: what
        cannot be parsed has lexical readings, and elements that nothing closes are no depth, since no tree has them."""
        raw = self.bytes(name)
        if name not in self.sound:
            if b"<!entity" in raw.lower():
                raise UnsafeArchive(f"{name!r} declares an entity")
            parser, shape = sax.make_parser(), _Shape(name, self.limits)
            parser.setContentHandler(shape)
            try:
                for at in range(0, len(raw), PIECE):
                    parser.feed(raw[at : at + PIECE])
                parser.close()
            except sax.SAXException:
                pass
            else:
                too_deep(name, shape.deepest, self.limits)
            self.sound.add(name)
        return raw

    def tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.xml(name))


def encrypted_resources(root: ElementTree.Element) -> list[tuple[str, str]]:
    """(URI, algorithm) of each resource that an encryption document names; '' for what it leaves out."""
    ends = lambda e, name: e.tag.endswith("}" + name) or e.tag == name
    first = lambda e, name, key: next((x.get(key, "") for x in e.iter() if ends(x, name)), "")
    return [(first(e, "CipherReference", "URI"), first(e, "EncryptionMethod", "Algorithm")) for e in root.iter() if ends(e, "EncryptedData")]


def refuse_encryption(archive: Archive) -> None:
    """Fonts may be obfuscated by the two standard algorithms; any other encrypted content makes a book unreadable."""
    if not archive.has(ENCRYPTION):
        return
    try:
        rows = encrypted_resources(archive.tree(ENCRYPTION))
    except ElementTree.ParseError as error:
        raise UnsafeArchive(f"{ENCRYPTION} is invalid: {error}") from error
    locked = [
        uri or "a resource without a name" for uri,
        how in rows if how not in FONT_ALGORITHMS or not unquote(urlsplit(uri).path).casefold().endswith(FONT_SUFFIXES)
    ]
    if locked:
        raise UnsafeArchive(f"content is encrypted: {', '.join(u[:200] for u in locked[:5])}")
