"""Exhaustive search for literal phrases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import caseless
from quire.operators.sequences import passages
from quire.sources.tables import durable

try:
    import ahocorasick
except ModuleNotFoundError:  # each needle is looked for by itself then
    ahocorasick = None


def occurrences(text: Column, query: Column) -> Column:
    """Offsets of the leftmost non-overlapping occurrences: the running length of what stands between them."""
    between = F.split(text, F.concat(F.lit("\\Q"), F.replace(query, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    steps = F.transform(F.slice(between, F.lit(1), F.greatest(F.size(between) - 1, F.lit(0))), lambda p: F.length(p))
    add = lambda s, n: F.struct((s["at"] + n + F.length(query)).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), add, lambda s: s["out"])


NEEDLES = 50_000  # in one pass over the texts: a few MB of automaton in a task


def _contained(needles: list[str]):
    """array<int>: numbers of the needles that a text contains, by one pass over it whatever their number."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        if ahocorasick is None:
            return texts.map(lambda t: [i for i, n in enumerate(needles) if n in t])
        automaton = ahocorasick.Automaton()
        for i, needle in enumerate(needles):
            automaton.add_word(needle, i)
        automaton.make_automaton()
        return texts.map(lambda t: sorted({i for _, i in automaton.iter(t)}))

    return run


def find_text(sequences: DataFrame, queries: DataFrame, case_sensitive: bool = False, most: int = NEEDLES) -> DataFrame:
    """Every occurrence of every query (query) in sequences, with its passage and anchor.

    Without regard to case, both sides are folded as far as it keeps their length, so offsets hold in the original: a letter
    that folds to several characters matches itself alone. Empty and null queries are dropped. A pass over the texts looks
    for up to `most` needles at once, which go to the tasks; more of them take more passes. Texts are not shuffled, and only
    those that contain a needle are kept with it.
    """
    key = (lambda c: c) if case_sensitive else caseless
    wanted = queries.select("query").where("query is not null and query != ''").distinct().withColumn("_needle", key(F.col("query")))
    wanted = durable(wanted, "search-queries")
    needles = wanted.select("_needle").distinct()
    passes = max(1, -(-needles.count() // most))
    hay = sequences.withColumn("_hay", key(F.col("text"))).where("_hay is not null")
    found = None
    for p in range(passes):
        own = [r["_needle"] for r in needles.where(F.pmod(F.xxhash64("_needle"), F.lit(passes)) == p).collect()]  # about `most`
        if not own:
            continue
        names = F.broadcast(sequences.sparkSession.createDataFrame(list(enumerate(own)), "_number int, _needle string"))
        hits = hay.withColumn("_numbers", _contained(own).asNondeterministic()("_hay")).where(F.size("_numbers") > 0)
        part = hits.withColumn("_number", F.explode("_numbers")).drop("_numbers").join(names, "_number").drop("_number")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = hay.where("false").withColumn("_needle", F.lit(""))
    both = found.join(F.broadcast(wanted) if passes == 1 else wanted, "_needle")  # counted: few, or a shuffle of the hits
    at = F.transform(occurrences(F.col("_hay"), F.col("_needle")), lambda a: F.struct(a.alias("start"), (a + F.length("_needle")).alias("stop")))
    cut = passages(both, at, "query")
    return cut.select(
        "query", "book_id", "href", "category", "sequence_id", F.col("cut.start").alias("start"), F.col("cut.stop").alias("stop"), "text", "anchor"
    )
