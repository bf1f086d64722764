"""Tables of documents, pages and turns in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import SPACE, squeeze


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BOOK = 500  # ids in a book at most, so that no window over a book has to hold a source


def book_of() -> Column:
    """A source's documents, in books of bounded size."""
    return F.concat_ws("-", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / BOOK).cast("string"))


def _place() -> Column:
    return F.row_number().over(Window.partitionBy(book_of()).orderBy("doc_id")) - 1


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as spine documents: books of a source, in the order of the ids, a non-blank line a paragraph."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    none = F.lit(None).cast("string")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: squeeze(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return docs.select(
        book_of().alias("book_id"), F.col("doc_id").cast("string").alias("href"), _place().alias("spine_index"), F.lit(True).alias("linear"),
        none.alias("title"), none.alias("title_source"), squeeze("text").alias("text"), lines.alias("paragraphs"), empty.alias("epub_types"),
        empty.alias("aria"), empty.alias("document_epub_types"), empty.alias("document_aria"),
        F.lit(0).alias("images"), F.array().cast("array<struct<src_id:string,dst_href:string,dst_id:string>>").alias("links"),
        F.col("lang").alias("language"), F.col("doc_id"),
    )


def line_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sections with their lines as atoms, all prose and in order."""
    atom = lambda p, i: F.struct(
        F.format_string("/p[%d]", i + 1).alias("xpath"), p.alias("text"), F.lit("prose").alias("shape"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("int").alias("level"), F.array().cast("array<string>").alias("epub_types"),
        F.array().cast("array<string>").alias("aria"), F.array().cast("array<string>").alias("markers"), F.lit(0).alias("links"), F.lit(0).alias("images"),
    )
    return sections(spark, sf_dir).withColumn("atoms", F.transform("paragraphs", atom)).withColumn("broken", F.lit(False))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return sections(spark, sf_dir).select("book_id").distinct().select(
        "book_id", none.alias("title"), none.alias("language"), F.array().cast("array<struct<role:string,href:string>>").alias("landmarks")
    )


def language_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as units of one document a source, with categories by language, so that runs of several units occur."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    names = F.when(F.col("lang") == "en", "work_text").when(F.col("lang") == "de", "note").when(F.col("lang") == "fr", "bibliography").otherwise("index")
    from quire.functions.lexical import use_of_category
    from quire.functions.text import fingerprint

    text = squeeze("text")
    fragment = F.array(F.struct(
        F.concat(F.lit("/d["), "doc_id", F.lit("]")).alias("xpath"), F.lit(0).alias("start"), F.length(text).alias("stop"),
        fingerprint(text, 20).alias("fingerprint"), F.lit(0).alias("source_start")
    ))
    return docs.select(
        book_of().alias("book_id"), F.col("doc_id").cast("string").alias("unit_id"), _place().alias("order"), F.lit("all").alias("href"),
        F.lit(None).cast("string").alias("title"), text.alias("text"), names.alias("category"), use_of_category(names).alias("use"),
        F.lit(1.0).alias("confidence"), F.lit("lang").alias("source"), F.array(F.coalesce("lang", F.lit(""))).alias("evidence"),
        fragment.alias("fragments"),
    )


def words(text):
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
