"""Human review: annotations and decisions on findings as logs of events, and what is exported of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import vocab as V
from quire.operators.profiles import overlapping


TARGET = ["book_id", "scope", "href", "block_id", "range_id"]


def latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of each key; a deletion (deleted = true) removes it."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("updated_at").desc()))
    return events.withColumn("_n", newest).where("_n = 1 and not coalesce(deleted, false)").drop("_n", "deleted")


ANNOTATION = (
    "book_id string, scope string, label string, href string, block_id string, xpath string, fingerprint string, range_id string, start int, end int,"
    "text_fingerprint string, note string, updated_at string, deleted boolean"
)
DECISION = "book_id string, finding_id string, decision string, category string, note string, updated_at string, deleted boolean"


class Session:
    """A review as a folder of logs that only grow: annotations, decisions, and findings of audits.

    Every change is an event with the time that its maker gives it; what holds is the latest event of each target, so
    several reviewers may append at once, and nothing is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, events: DataFrame, name: str, schema: str) -> None:
        wanted = self.spark.createDataFrame([], schema).schema
        events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("append").parquet(f"{self.path}/{name}")

    def _log(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def annotate(self, events: DataFrame) -> None:
        """Annotations and their deletions; ranges that overlap one that holds are refused."""
        both = latest(self._log("annotations", ANNOTATION).unionByName(events.select(*self._log("annotations", ANNOTATION).columns)), TARGET)
        found = range_conflicts(both.where("scope = 'range'")).select("book_id", "href", "block_id", "range_id").limit(3).collect()
        if found:
            raise ValueError(f"overlapping ranges: {', '.join('#'.join(map(str, r)) for r in found)}")
        self._append(events, "annotations", ANNOTATION)

    def decide(self, events: DataFrame) -> None:
        """Decisions on findings and their withdrawal."""
        self._append(events, "decisions", DECISION)

    def annotations(self) -> DataFrame:
        return latest(self._log("annotations", ANNOTATION), TARGET)

    def decisions(self) -> DataFrame:
        return latest(self._log("decisions", DECISION), ["book_id", "finding_id"])

    def export(self, findings: DataFrame) -> DataFrame:
        """One annotation a target, of what was annotated by hand and of the accepted findings."""
        return annotations_for_export(findings, self._log("decisions", DECISION), self._log("annotations", ANNOTATION))


def accept_all(findings: DataFrame, updated_at: str) -> DataFrame:
    """Decisions that accept every finding that can become an override."""
    return findings.where("can_override").select(
        "book_id", "finding_id", F.lit("accepted").alias("decision"), F.col("proposed_category").alias("category"), F.lit("").alias("note"),
        F.lit(updated_at).alias("updated_at"), F.lit(False).alias("deleted")
    )


def range_conflicts(ranges: DataFrame) -> DataFrame:
    """Annotated ranges that overlap an earlier one of their block."""
    return overlapping(ranges, ["book_id", "href", "block_id"])


def annotations_for_export(findings: DataFrame, decisions: DataFrame, manual: DataFrame) -> DataFrame:
    """One annotation a target: a manual one if there is any, else the latest accepted or edited finding.

    findings: as validated, with run (the time of their audit). decisions: book_id, finding_id, decision, category, note,
    updated_at, deleted. manual: book_id, scope, label, href, block_id, xpath, fingerprint, range_id, start, end,
    text_fingerprint, note, updated_at, deleted.
    """
    kept = latest(decisions, ["book_id", "finding_id"]).where(F.col("decision").isin("accepted", "edited") & F.col("category").isin(*V.CATEGORIES))
    approved = findings.where("can_override").join(
        kept.select("book_id", "finding_id", "category", F.col("note").alias("_note"), F.col("updated_at").alias("_at")), ["book_id", "finding_id"]
    )
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    suggested = approved.select(
        "book_id", "scope", F.col("category").alias("label"), "href", "block_id", "xpath", "fingerprint", none("string", "range_id"),
        none("int", "start"), none("int", "end"), none("string", "text_fingerprint"),
        F.coalesce(F.nullif("_note", F.lit("")), "explanation").alias("note"), F.col("_at").alias("updated_at"), F.lit(0).alias("_rank"),
        F.col("run").alias("_run"),
    )
    target = TARGET
    own = latest(manual, target).withColumns({"_rank": F.lit(1), "_run": F.col("updated_at")})
    both = suggested.unionByName(own.select(*suggested.columns))
    best = F.row_number().over(Window.partitionBy(*[F.coalesce(c, F.lit("")) for c in target]).orderBy(F.col("_rank").desc(), F.col("_run").desc()))
    return both.withColumn("_n", best).where("_n = 1").drop("_n", "_rank", "_run")
