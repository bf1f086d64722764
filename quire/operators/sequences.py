"""Sequences of units that no boundary interrupts, and passages of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import vocab as V
from quire.functions.text import bound, fingerprint, joined_id
from quire.operators.units import anchor, point, trimmed
from quire.sources.tables import durable

SEPARATOR = "\n\n"


def chosen(categories) -> list[str]:
    """Category names: a collection of them, or "all"."""
    if categories == "all":
        return list(V.CATEGORIES)
    if isinstance(categories, str):
        raise ValueError('categories must be a collection of names or "all"')
    names = list(dict.fromkeys(categories))
    unknown = [n for n in names if n not in V.CATEGORIES]
    if unknown:
        raise ValueError(f"unknown categories: {', '.join(map(str, unknown))}")
    return names


def sequences(units: DataFrame, categories=("work_text",)) -> DataFrame:
    """Maximal runs of units that follow each other in one document with the same category and use.

    Categories are chosen first: what is not chosen leaves gaps, and a gap ends a run. Texts are joined by a blank line;
    parts say where each unit stands, stops and starts where its elements end and begin.
    """
    kept = units.where(F.col("category").isin(chosen(categories)))
    order = Window.partitionBy("book_id").orderBy("order")
    same = (F.col("order") == F.lag("order").over(order) + 1) & (F.col("href") == F.lag("href").over(order)) & (
        F.col("category") == F.lag("category").over(order)
    ) & (F.col("use") == F.lag("use").over(order))
    runs = kept.withColumn("run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order))
    cast = F.struct("order", "unit_id", "text", "title", "confidence", "source", "evidence", "fragments")
    grouped = runs.groupBy("book_id", "run", "href", "category", "use").agg(F.array_sort(F.collect_list(cast)).alias("us"))
    lengths = F.transform("us", lambda u: F.length(u["text"]))
    starts = F.aggregate(lengths, F.expr("array(0)"), lambda s, n: F.concat(s, F.array(F.get(s, F.size(s) - 1) + n + len(SEPARATOR))))
    placed = grouped.withColumn("_starts", starts).withColumn(
        "units",
        F.transform(
            "us",
            lambda u, i: F.struct(
                u["unit_id"].alias("unit_id"), F.get("_starts", i).alias("start"), (F.get("_starts", i) + F.length(u["text"])).alias("stop"),
                u["text"].alias("text"), u["title"].alias("title"),
                u["confidence"].alias("confidence"), u["source"].alias("source"), u["evidence"].alias("evidence"), u["fragments"].alias("fragments"),
            ),
        ),
    )
    ends = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform(
        "units", lambda u: F.transform(u["fragments"], lambda f: u["start"] + f[field])
    ))))
    first, last = F.get("units", F.lit(0)), F.get("units", F.size("units") - 1)
    return placed.select(
        "book_id",
        joined_id("book_id", "href", "category", first["unit_id"], last["unit_id"]).alias("sequence_id"),
        F.get("us", F.lit(0))["order"].alias("first_order"),
        "href",
        "category",
        "use",
        F.array_join(F.transform("us", lambda u: u["text"]), SEPARATOR).alias("text"),
        ends("stop").alias("stops"),
        ends("start").alias("starts"),
        "units",
    )


def passages(sequences_: DataFrame, cuts: Column, *keep: str, trim: bool = True) -> DataFrame:
    """Passages of sequences at cuts, an array of structs with start and stop: one row each with the cut, the passage (start,
    stop, text, unit_ids, titles, confidence, sources, evidence, anchor and id) and the columns of keep.

    A text is without whitespace at its ends (trim=False: the cuts are); an anchor spans the first and the last unit that it
    touches. Offsets outside of a text, and blank slices, give no row. Every field is a column of its own, computed from the
    cut, so that a consumer pays only for those that it reads; lengths of texts are counted once a sequence.
    """
    inside = bound(F.length("text"), lambda n: F.filter(cuts, lambda c: (c["start"] >= 0) & (c["stop"] <= n) & (c["start"] < c["stop"])))
    ends = lambda c: trimmed(F.col("text"), c["start"], c["stop"]) if trim else F.struct(c["start"].alias("start"), c["stop"].alias("stop"))
    spots = F.transform(inside, lambda c: F.struct(c.alias("cut"), ends(c).alias("e")))
    own = ["book_id", "sequence_id", "href", "category", "use", *keep]
    each = sequences_.select(*own, F.col("text").alias("_whole"), F.col("units").alias("_units"), F.explode(spots).alias("x"))
    if trim:
        each = each.where("x.e.start < x.e.stop")
    placed = each.select(*own, "_whole", "_units", "x.cut", "x.e.start", "x.e.stop")
    a, b, t = F.col("start"), F.col("stop"), F.col("_touched")
    told = placed.select(
        *own, "cut", "start", "stop", F.substring("_whole", a + 1, b - a).alias("text"),
        F.filter("_units", lambda u: (u["stop"] > a) & (u["start"] < b)).alias("_touched")
    )
    first, last = F.get(t, F.lit(0)), F.get(t, F.size(t) - 1)
    place = anchor(
        F.col("book_id"), F.col("href"), point(first["fragments"], first["text"], a - first["start"]),
        point(last["fragments"], last["text"], F.least(last["stop"], b) - last["start"], final=True), F.col("text")
    )
    built = told.select(
        *own, "cut", "start", "stop", "text",
        F.transform(t, lambda u: u["unit_id"]).alias("unit_ids"),
        F.array_distinct(F.filter(F.transform(t, lambda u: u["title"]), lambda x: x.isNotNull() & (x != ""))).alias("titles"),
        F.array_min(F.transform(t, lambda u: u["confidence"])).alias("confidence"),
        F.array_distinct(F.transform(t, lambda u: u["source"])).alias("sources"),
        F.array_distinct(F.flatten(F.transform(t, lambda u: u["evidence"]))).alias("evidence"),
        place.alias("anchor"),
    )
    p = F.col("anchor")
    return built.withColumn("id", joined_id(
        "book_id", "sequence_id", p["start"]["xpath"], p["start"]["offset"], p["end"]["xpath"], p["end"]["offset"], p["text_fingerprint"]
    ))


def resolve_sources(sources: DataFrame, units: DataFrame) -> DataFrame:
    """Adds resolved (the text that an anchor names, null if its elements are not found) and verified to rows with an anchor.

    The elements are found by book, document, xpath, fingerprint and offset, so an anchor outlives any cut into chunks.
    Equal anchors are resolved once. Both ends are looked up by all their fields, without text; then the places in between
    are listed and joined to the document's pieces by number, so an anchor meets no piece that it does not name.
    """
    a = F.col("anchor")
    key = F.sha2(
        F.to_json(F.struct(
            a["epub_sha256"], a["href"], *[a[e][f] for e in ("start", "end") for f in ("xpath", "element_fingerprint", "offset")],
            a["text_fingerprint"]
        )),
        256
    )
    named = durable(sources.withColumn("_source", key), "sources")  # cut, or read, once
    wanted = named.select(
        "_source", a["epub_sha256"].alias("book_id"), a["href"].alias("href"), a["start"].alias("_s"), a["end"].alias("_e"),
        a["text_fingerprint"].alias("_want")
    ).dropDuplicates(["_source"])
    wanted = durable(wanted, "source-anchors")
    # A piece goes on with its own text, never with that of its unit, which has many pieces.
    piece = lambda f: F.struct(
        f["xpath"].alias("xpath"), f["fingerprint"].alias("print"), f["source_start"].alias("from"),
        F.substring("text", f["start"] + 1, f["stop"] - f["start"]).alias("text")
    )
    pieces = units.select("book_id", "href", F.col("order").alias("_order"), F.posexplode(F.transform("fragments", piece)).alias("_at", "_f"))
    place = F.row_number().over(Window.partitionBy("book_id", "href").orderBy("_order", "_at"))
    spots = durable(pieces.withColumn("_place", place).select(
        "book_id", "href", "_place", F.col("_f.xpath").alias("_xpath"), F.col("_f.print").alias("_print"), F.col("_f.from").alias("_from"),
        F.col("_f.text").alias("_text")
    ), "source-pieces")
    slim = spots.select("book_id", "href", "_place", "_xpath", "_print", "_from", F.length("_text").alias("_length"))
    at = lambda end: wanted.select(
        "_source", "book_id", "href", F.col(f"{end}.xpath").alias("_xpath"), F.col(f"{end}.element_fingerprint").alias("_print"),
        F.col(f"{end}.offset").alias("_offset")
    )
    same = ["book_id", "href", "_xpath", "_print"]
    begins = at("_s").join(slim, same).where(
        "_from <= _offset and _offset < _from + _length"
    ).groupBy("_source").agg(F.min(F.struct("_place", "_from")).alias("_b"))
    stops = at("_e").join(slim, same).where("_from < _offset and _offset <= _from + _length").select("_source", F.struct("_place", "_from").alias("_z"))
    ends = stops.join(begins, "_source").where("_z._place >= _b._place").groupBy("_source", "_b").agg(F.min("_z").alias("_z"))
    spans = wanted.join(ends, "_source").withColumn("_place", F.explode(F.sequence("_b._place", "_z._place")))
    used = spans.join(spots.select("book_id", "href", "_place", "_text"), ["book_id", "href", "_place"])
    first = F.when(F.col("_place") == F.col("_b._place"), F.col("_s.offset") - F.col("_b._from")).otherwise(0)
    last = F.when(F.col("_place") == F.col("_z._place"), F.col("_e.offset") - F.col("_z._from")).otherwise(F.length("_text"))
    cut = used.withColumn("_part", F.substring("_text", first + 1, last - first))
    joined = cut.groupBy("_source", "_want").agg(F.array_sort(F.collect_list(F.struct("_place", "_part"))).alias("_parts"))
    whole = F.array_join(F.filter(F.transform("_parts", lambda p: p["_part"]), lambda p: p != ""), " ")
    found = joined.select("_source", whole.alias("resolved"), (fingerprint(whole, 24) == F.col("_want")).alias("_same"))
    return named.join(found, "_source", "left").withColumn("verified", F.coalesce("_same", F.lit(False))).drop("_source", "_same")
