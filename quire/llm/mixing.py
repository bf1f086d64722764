"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a fixed 60-bit hash. A source that is to give a share of its words gives the documents whose hash is
below a threshold, so a smaller budget always selects a subset of a larger one. The threshold comes from histograms:
words are summed by source and hash bucket, running sums (at most 4,096 buckets a source) find the bucket in which the
budget ends, only that bucket is summed again by finer buckets, and its last sixteen-millionth by single hashes. No step
sorts documents, and a source with a third of all rows costs no more than its buckets, since every sum is combined
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import durable, hint_small

BITS = 12  # of the hash for each histogram
LEVELS = 2


def words(text: Column) -> Column:
    """Number of runs of other characters than ASCII whitespace."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the id's MD5; without an id of the text's, so that rows without id are told apart."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): the sources by code point, null last, take the weights in turn.

    A target is min(most x size, level x weight), with the one level at which targets add up to share x all sizes: what
    a full source leaves goes to the others by weight. Sources are full in the order of size/weight, so running sums in
    that order give the level without iterating: at each source the level that would hold if just those before it were
    full. It is consistent where it does not fill the source itself, and of these the first is also the highest. The
    windows run over one row a source.
    """
    turn = F.when(F.lit(False), F.lit(0))
    for i, w in enumerate(weights):
        turn = turn.when(F.col("_place") % len(weights) == i, w)
    by_size = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_size.withColumn("_place", F.row_number().over(order) - 1).withColumn("_w", turn.cast("long"))
    before = Window.orderBy("_fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        weighed.withColumn("_fill", F.col("source_size") * F.lit(most) / F.col("_w"))
        .withColumn("_size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_w_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("_size_before") * F.lit(most)) / F.col("_w_left"))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(whole))
    )
    level = F.coalesce(F.col("_level") * F.col("_w"), F.col("source_size") * F.lit(most))
    return ranked.select("source", "source_size", F.least(level, F.col("source_size") * F.lit(most)).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("_hash", 60 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, _below, _upto): documents with a hash below _below are in the budget, and those up to _upto where not null.

    sized: source, size, _hash. budgets: source, _budget (words). The last hash is taken if that comes nearer to the budget.
    """
    state = budgets.select(F.col("source").alias("_s"), F.col("_budget").cast("double").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        found = sized.join(hint_small(state, "mixing-state"), F.col("source").eqNullSafe(F.col("_s")))
        if level:
            found = found.where(F.shiftright("_hash", 60 - BITS * level) == F.col("_prefix"))
        sums = found.groupBy("_s", "_left", "_prefix", _bucket(level).alias("_b")).agg(F.sum("size").alias("_n"))
        run = Window.partitionBy("_s").orderBy("_b")
        cut = sums.withColumn("_upto", F.sum("_n").over(run)).where(F.col("_upto") > F.col("_left"))
        first = cut.groupBy("_s", "_left", "_prefix").agg(F.min(F.struct("_b", "_upto", "_n")).alias("_m"))
        # The budget ends in this bucket; a source whose rows all fit has no such bucket and needs no threshold.
        state = first.select(
            "_s", (F.col("_left") - F.col("_m._upto") + F.col("_m._n")).alias("_left"),
            (F.col("_prefix") * (1 << BITS) + F.col("_m._b")).alias("_prefix")
        )
    inside = sized.join(
        hint_small(state, "mixing-state"), F.col("source").eqNullSafe(F.col("_s"))
    ).where(F.shiftright("_hash", 60 - BITS * LEVELS) == F.col("_prefix"))
    single = inside.groupBy("_s", "_left", "_hash").agg(F.sum("size").alias("_n"))
    run = Window.partitionBy("_s").orderBy("_hash")
    cut = single.withColumn("_sum", F.sum("_n").over(run)).where(F.col("_sum") > F.col("_left"))
    last = cut.groupBy("_s", "_left").agg(F.min(F.struct("_hash", "_sum", "_n")).alias("_m"))
    near = F.col("_m._sum") - F.col("_left") < F.col("_left") - (F.col("_m._sum") - F.col("_m._n"))
    return last.select(F.col("_s"), F.when(near, F.col("_m._hash") + 1).otherwise(F.col("_m._hash")).alias("_below"))


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """sized: doc_id, source, size, _hash by document; plan: _t (source), source_size, target, _rounds, _below by source."""
    sized = durable(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
            doc_hash(F.col(id_col), F.col(text_col)).alias("_hash")
        ),
        "mixing-sizes",
    )
    targets = durable(source_targets(sized, weights, share, float(most)), "mixing-targets")
    # Whole rounds take everything; the rest of the target is a budget below one round.
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    rounds = targets.withColumn("_rounds", whole.cast("long"))
    budgets = rounds.select("source", (F.col("target") - F.col("_rounds") * F.col("source_size")).alias("_budget")).where("_budget > 0")
    cuts = thresholds(sized, budgets)
    plan = rounds.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_t"), "source_size", "target", "_rounds", F.coalesce("_below", F.lit(0)).alias("_below")
    )
    # One row a source: broadcast if counted to be few, so that a source with a third of all rows is not dealt to one task.
    return sized, hint_small(plan, "mixing-plan")


_COPIES = "cast(_rounds + if(_hash < _below, 1, 0) as long)"


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs.

    copies is how often the mix takes the document (0 to most), taken = copies x size. Rows with one hash are taken
    together: those that repeat an id, and those without id that repeat a text. Each source's taken words differ from its
    target by at most half of what one hash has, which is half of one document where ids do not repeat. Null texts have
    size 0; a null source is a source of its own, last in order; other columns are ignored; no rows give none.
    """
    sized, plan = plan_mix(docs, weights, share, most, **columns)
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_t")))
        .withColumn("copies", F.expr(_COPIES))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source"
) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it. Texts are not moved.

    Nulls, repeated rows, empty texts and empty tables are handled as in mix(); columns keep their names, whatever those are.
    """
    _, plan = plan_mix(docs, weights, share, most, id_col=id_col, text_col=text_col, source_col=source_col)
    # Whole rows are carried in a struct, so no name of theirs meets one of the plan's.
    packed = docs.select(F.struct("*").alias("_row"), doc_hash(F.col(id_col), F.col(text_col)).alias("_hash"), F.col(source_col).alias("_source"))
    taken = packed.join(plan, F.col("_source").eqNullSafe(F.col("_t"))).withColumn("_copies", F.expr(_COPIES)).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE / w AS fill FROM w),
r AS (SELECT *, coalesce(sum(source_size) OVER b, 0) AS size_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left,
             sum(source_size) OVER () AS total
      FROM f WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - size_before::DOUBLE * 2.0::DOUBLE) / w_left::DOUBLE AS level FROM r),
t AS (SELECT source, source_size, least(coalesce(max(CASE WHEN level <= fill THEN level END) OVER () * w, source_size * 2.0::DOUBLE),
             source_size * 2.0::DOUBLE)::DOUBLE AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS rounds FROM t),
c AS (SELECT g.source, h, sum(size)::BIGINT AS n, any_value(target - rounds * source_size) AS budget
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY g.source, h),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
x AS (SELECT source, min(h) AS h, arg_min(upto, h) AS upto, arg_min(n, h) AS n, any_value(budget) AS budget FROM u
      WHERE upto > budget AND budget > 0 GROUP BY source),
y AS (SELECT source, CASE WHEN upto - budget < budget - (upto - n) THEN h + 1 ELSE h END AS below FROM x)
SELECT d.doc_id, d.size, g.source_size, g.target,
       ((g.rounds + CASE WHEN d.h < coalesce(y.below, 0) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source
"""
