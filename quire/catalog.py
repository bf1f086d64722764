"""Registry of this package's queries over the driver's tables."""

from __future__ import annotations

from quire.plans import epub_cases, rule_cases
from quire.plans.oracles import ORACLES as _TABLE_ORACLES
from quire.plans.table_queries import ALL

_CASES = (
    rule_cases.rule_cases, epub_cases.epub_books, epub_cases.epub_documents, epub_cases.epub_atoms, epub_cases.epub_links, epub_cases.epub_anchors,
    epub_cases.epub_votes, epub_cases.epub_units, epub_cases.epub_metadata, epub_cases.epub_records,
)

QUERIES = {f.__name__: f for f in (*ALL, *_CASES)}
ORACLES = _TABLE_ORACLES | {
    "rule_cases": rule_cases.ORACLE,
    "epub_books": epub_cases.BOOKS,
    "epub_documents": epub_cases.DOCUMENTS,
    "epub_atoms": epub_cases.ATOMS,
    "epub_links": epub_cases.LINKS,
    "epub_anchors": epub_cases.ANCHORS,
    "epub_votes": epub_cases.VOTES,
    "epub_units": epub_cases.UNITS,
    "epub_metadata": epub_cases.METADATA,
    "epub_records": epub_cases.RECORDS,
}

__all__ = ["ORACLES", "QUERIES"]
