"""Units: classified blocks in reading order, each with the place in the source that proves it; and their coverage.

A source point is (xpath, offset in that element's text, fingerprint of that element, context); an anchor is two points in
one document with the fingerprint and the beginning of the text between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import vocab as V
from quire.functions.text import SPACE, bound, fingerprint, joined_id, squeeze, squeezed_print

QUOTE = 180
CONTEXT = 45


def point(fragments: Column, text: Column, offset: Column, final: bool = False) -> Column:
    """The source point at an offset of a unit's text: of the fragment that goes on after it, or, for an end, that comes before."""

    def found(at: Column) -> Column:
        if final:
            return bound(
                F.filter(fragments, lambda f: f["start"] < at),
                lambda before: F.coalesce(F.get(before, F.size(before) - 1), F.get(fragments, F.lit(0)))
            )
        return F.coalesce(F.get(F.filter(fragments, lambda f: f["stop"] > at), F.lit(0)), F.get(fragments, F.size(fragments) - 1))

    def described(at: Column, fragment: Column) -> Column:
        inside = F.greatest(F.lit(0), F.least(fragment["stop"] - fragment["start"], at - fragment["start"]))
        left = F.greatest(F.lit(0), at - CONTEXT)
        return F.struct(
            fragment["xpath"].alias("xpath"),
            (fragment["source_start"] + inside).alias("offset"),
            fragment["fingerprint"].alias("element_fingerprint"),
            F.substring(text, left + 1, at + CONTEXT - left).alias("context"),
        )

    return bound(F.greatest(F.lit(0), F.least(F.length(text), offset)), lambda at: bound(found(at), lambda fragment: described(at, fragment)))


def anchor(book_id: Column, href: Column, start: Column, stop: Column, text: Column) -> Column:
    return bound(squeeze(text), lambda plain: F.struct(
        book_id.alias("epub_sha256"), href.alias("href"), start.alias("start"), stop.alias("end"), squeezed_print(plain, 24).alias("text_fingerprint"),
        F.left(plain, F.lit(QUOTE)).alias("quote")
    ))


def trimmed(text: Column, start: Column, stop: Column) -> Column:
    """struct(start, stop) without the whitespace at either end of the slice."""

    def between(n: Column) -> Column:
        a = F.greatest(F.lit(0), F.least(n, start))
        b = F.greatest(a, F.least(n, stop))
        return bound(F.substring(text, a + 1, b - a), lambda part: ends(part, a, b))

    def ends(part: Column, a: Column, b: Column) -> Column:
        ahead = F.length(part) - F.length(F.regexp_replace(part, f"^{SPACE}+", ""))
        behind = F.length(part) - F.length(F.regexp_replace(part, f"{SPACE}+$", ""))
        blank = ahead == F.length(part)
        return F.struct(F.when(blank, b).otherwise(a + ahead).alias("start"), F.when(blank, b).otherwise(b - behind).alias("stop"))

    return bound(F.length(text), between)


def units(classified: DataFrame) -> DataFrame:
    """One unit a block, numbered within its book."""
    fragments = F.when(F.size("fragments") > 0, F.col("fragments")).otherwise(
        F.array(F.struct(
            F.col("xpath"), F.lit(0).alias("start"), F.length("text").alias("stop"), fingerprint("text", 20).alias("fingerprint"),
            F.lit(0).alias("source_start")
        ))
    )
    staged = classified.withColumn("fragments", fragments)
    first, last = F.get("fragments", F.lit(0)), F.get("fragments", F.size("fragments") - 1)
    whole = anchor(
        F.col("book_id"),
        F.col("href"),
        F.struct(first["xpath"].alias("xpath"), F.lit(0).alias("offset"), first["fingerprint"].alias("element_fingerprint"), F.lit("").alias("context")),
        F.struct(
            last["xpath"].alias("xpath"), (last["stop"] - last["start"]).alias("offset"), last["fingerprint"].alias("element_fingerprint"),
            F.lit("").alias("context")
        ),
        F.col("text"),
    )
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("spine_index", "block_index")) - 1
    return staged.select(
        "book_id",
        joined_id("book_id", "href", first["xpath"], last["xpath"], last["stop"], fingerprint("text", 24)).alias("unit_id"),
        order.alias("order"),
        "block_id",
        "href",
        "spine_index",
        "block_index",
        "title",
        "text",
        "category",
        "use",
        "confidence",
        "source",
        "evidence",
        whole.alias("anchor"),
        "fragments",
    )


def slice_fragments(fragments: Column, start: Column, stop: Column) -> Column:
    """The parts of fragments inside of a slice, with offsets in the slice and in the source."""
    cut = F.filter(fragments, lambda f: F.greatest(start, f["start"]) < F.least(stop, f["stop"]))
    return F.transform(
        cut,
        lambda f: F.struct(
            f["xpath"].alias("xpath"),
            (F.greatest(start, f["start"]) - start).alias("start"),
            (F.least(stop, f["stop"]) - start).alias("stop"),
            f["fingerprint"].alias("fingerprint"),
            (f["source_start"] + F.greatest(start, f["start"]) - f["start"]).alias("source_start"),
        ),
    )


def split_ranges(units_: DataFrame, ranges: DataFrame) -> DataFrame:
    """Units cut where ranges (book_id, href, block_id, range_id, start, stop, category) give a part another category.

    The pieces' texts add up to the unit's; pieces between ranges keep its category. All units are numbered anew.
    """
    from quire.functions.lexical import use_of_category

    per_unit = ranges.groupBy("book_id", "href", "block_id").agg(F.array_sort(F.collect_list(F.struct(
        "start", "stop", "range_id", F.col("category").alias("to")
    ))).alias("cuts"))
    both = units_.join(per_unit, ["book_id", "href", "block_id"], "left")
    piece = lambda a, b, r, to: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), r.alias("range_id"), to.alias("to"))
    none = F.lit(None).cast("string")
    after = F.transform("cuts", lambda c, i: piece(c["stop"], F.coalesce(F.get("cuts", i + 1)["start"], F.length("text")), none, none))
    inside = F.transform("cuts", lambda c: piece(c["start"], c["stop"], c["range_id"], c["to"]))
    ahead = F.array(piece(F.lit(0), F.get("cuts", F.lit(0))["start"], none, none))
    pieces = F.when(
        F.col("cuts").isNull(), F.array(piece(F.lit(0), F.length("text"), none, none))
    ).otherwise(F.array_sort(F.filter(F.concat(ahead, inside, after), lambda p: p["a"] < p["b"])))
    cut = both.withColumn("_whole", F.col("cuts").isNull()).select("*", F.posexplode(pieces).alias("_i", "_p")).drop("cuts")
    a, b = F.col("_p.a"), F.col("_p.b")
    part = cut.withColumns({
        "_text": F.substring("text", a + 1, b - a), "_fragments": slice_fragments(F.col("fragments"), a, b),
        "_category": F.coalesce("_p.to", "category")
    })
    ends = trimmed(F.col("_text"), F.lit(0), F.length("_text"))
    part = part.withColumn("_ends", ends)
    moved = anchor(
        F.col("book_id"), F.col("href"), point(F.col("_fragments"), F.col("_text"), F.col("_ends.start")),
        point(F.col("_fragments"), F.col("_text"), F.col("_ends.stop"), final=True), F.col("_text")
    )
    ranged = F.col("_p.range_id").isNotNull()
    keep = lambda name, new: F.when(F.col("_whole"), F.col(name)).otherwise(new).alias(name)
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("order", "_i")) - 1
    said = F.concat(F.lit("range override: "), F.col("_p.range_id"), F.lit(" -> "), F.col("_category"))
    out = part.select(
        "book_id",
        keep("unit_id", joined_id("unit_id", "_p.a", "_p.b", "_category")),
        order.alias("_order"),
        "block_id", "href", "spine_index", "block_index", "title",
        keep("text", F.col("_text")),
        keep("category", F.col("_category")),
        keep("use", use_of_category("_category")),
        keep("confidence", F.when(ranged, 1.0).otherwise(F.col("confidence"))),
        keep("source", F.when(ranged, "edition_profile_range").otherwise(F.col("source"))),
        keep("evidence", F.when(ranged, F.concat("evidence", F.array(said))).otherwise(F.col("evidence"))),
        keep("anchor", moved),
        keep("fragments", F.col("_fragments")),
    )
    return out.select("book_id", "unit_id", F.col("_order").alias("order"), *[c for c in out.columns if c not in ("book_id", "unit_id", "_order")])


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("chars"))), F.lit(0))


def document_coverage(documents: DataFrame, units_: DataFrame) -> DataFrame:
    """Characters of every document by use and category, and whether they account for its visible text.

    The difference may be 64 characters, one percent, or one character between any two units; text of a document that
    holds images and no unit counts as not visible.
    """
    sized = units_.withColumn("chars", F.length("text"))
    by_category = sized.groupBy("book_id", "href", "category").agg(F.sum("chars").alias("c")).groupBy("book_id", "href").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "c")))).alias("by_category")
    )
    sums = sized.groupBy("book_id", "href").agg(
        F.count("*").alias("units"), F.sum("chars").alias("classified"), _sum_if(F.col("use") == V.MAIN).alias("main"),
        _sum_if(F.col("use") == V.ON_REQUEST).alias("notes")
    )
    docs = documents.select("book_id", "href", F.length("text").alias("visible"), "images", F.lit(True).alias("_known"))
    both = docs.join(sums, ["book_id", "href"], "full").join(by_category, ["book_id", "href"], "left")
    both = both.fillna(0, ["visible", "units", "classified", "main", "notes"]).withColumn("difference", F.col("visible") - F.col("classified"))
    unseen = F.when(F.coalesce("_known", F.lit(False)) & (F.col("units") == 0) & (F.col("images") > 0), F.greatest(F.lit(0), "difference")).otherwise(0)
    tolerance = F.greatest(F.lit(64), F.bround(F.col("visible") * 0.01), F.col("units") - 1)
    return both.withColumns({"not_visible": unseen, "anomaly": (F.abs("difference") > tolerance) & (unseen == 0)}).select(
        "book_id", "href", "visible", "units", "classified", "main", "notes",
        (F.col("classified") - F.col("main") - F.col("notes")).alias("excluded"), "difference", "not_visible", "anomaly",
        F.bround(F.col("main") / F.greatest(F.lit(1), "classified"), 6).alias("main_share"), "by_category",
    )


def exclusions(units_: DataFrame) -> DataFrame:
    """Units that are no text to read, with the reason."""
    return units_.where(F.col("use") == V.EXCLUDED).select(
        "book_id", "unit_id", "href", "category", F.length("text").alias("chars"), "source", "evidence",
        F.concat_ws(":", "category", "source").alias("reason")
    )


def book_coverage(documents: DataFrame, units_: DataFrame) -> DataFrame:
    """Sums over documents, and whether a book's units are complete, unique and traceable."""
    docs = document_coverage(documents, units_)
    sums = docs.groupBy("book_id").agg(
        *[F.sum(c).alias(c) for c in ("visible", "classified", "main", "notes", "excluded", "not_visible")],
        F.array_sort(F.collect_list(F.when(F.col("anomaly"), F.col("href")))).alias("anomalies"),
    )
    twice = units_.groupBy("book_id", "unit_id").agg(F.count("*").alias("n")).where("n > 1").groupBy("book_id").agg(
        F.array_sort(F.collect_list("unit_id")).alias("duplicates")
    )
    faults = units_.groupBy("book_id").agg(F.count_if(F.col("text") == "").alias("empty_units"), F.count_if(F.size("fragments") == 0).alias("untraced_units"))
    reasons = exclusions(units_).groupBy("book_id", "reason").agg(F.sum("chars").alias("c")).groupBy("book_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "c")))).alias("excluded_by_reason")
    )
    both = sums.join(twice, "book_id", "left").join(faults, "book_id", "left").join(reasons, "book_id", "left").fillna(0, ["empty_units", "untraced_units"])
    both = both.withColumn("duplicates", F.coalesce("duplicates", F.array().cast("array<string>")))
    adds_up = F.col("main") + F.col("notes") + F.col("excluded") == F.col("classified")
    share = lambda c: F.bround(c / F.greatest(F.lit(1), "classified"), 6)
    return both.withColumns({
        "main_share": share(F.col("main")),
        "searchable_share": share(F.col("main") + F.col("notes")),
        "valid": adds_up & (F.size("anomalies") == 0) & (F.size("duplicates") == 0) & (F.col("empty_units") == 0) & (F.col("untraced_units") == 0),
    })
