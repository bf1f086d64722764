"""Command line: python -m quire.cli FOLDER_OR_FILE [--format text|units-json|rag-jsonl] [-o OUTPUT]."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import SparkSession

from quire import __version__
from quire.functions.vocab import CATEGORIES
from quire.operators.profiles import load_profiles
from quire.plans.corpus import Corpus, Options
from quire.sources.sinks import records_jsonl, units_json


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire", description="Classified text and stable citations from EPUB files.")
    out.add_argument("epub")
    out.add_argument("-o", "--output", help="a local file")
    out.add_argument("--format", choices=("text", "units-json", "rag-jsonl"), default="text")
    out.add_argument("--category", action="append", choices=(*CATEGORIES, "all"), help="repeat for several (default: work_text)")
    out.add_argument("--edition-profile")
    for name, value in (("max", 350), ("min", 80), ("overlap", 40), ("context", 1200)):
        out.add_argument(f"--{name}-tokens", type=int, default=value)
    out.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    return out


def pieces(corpus: Corpus, args: argparse.Namespace) -> tuple[str, Iterator[str]]:
    """(what stands between two pieces, the pieces): a book, or a record, at a time, so that the driver never holds all."""
    categories = "all" if "all" in (args.category or ()) else tuple(args.category or ("work_text",))
    if args.format == "text":
        return "\n\n", (r["text"] for r in corpus.text(categories).orderBy("book_id").toLocalIterator())
    if args.format == "units-json":
        return "\n", (r["value"] for r in units_json(corpus.metadata(), corpus.units(categories)).orderBy("book_id").toLocalIterator())
    records = corpus.rag_records(categories, args.max_tokens, args.min_tokens, args.overlap_tokens, args.context_tokens)
    return "\n", (r["value"] for r in records_jsonl(records).orderBy("book_id", "first_order", "chunk").toLocalIterator())


def write(out: TextIO, between: str, parts: Iterator[str]) -> None:
    for i, part in enumerate(parts):
        out.write(between * (i > 0) + part)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    try:
        options = Options(profiles=load_profiles(spark, args.edition_profile) if args.edition_profile else None)
        corpus = Corpus.read(spark, args.epub, options)
        failed = [r["reason"] for r in corpus.rejected.collect()]
        if corpus.rejected_profiles is not None:
            failed += [r["reason"] for r in corpus.rejected_profiles.collect()]
        if failed:
            raise ValueError("; ".join(failed))
        between, parts = pieces(corpus, args)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as out:
                write(out, between, parts)
            print(f"Wrote {args.output}", file=sys.stderr)
        else:
            write(sys.stdout, between, parts)
            print()
        return 0
    except Exception as error:
        print(f"quire: error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
