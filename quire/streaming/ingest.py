"""Continuous intake: new EPUB files of a folder are extracted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.plans.corpus import Corpus, Options

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, options: Options | None = None, **trigger) -> StreamingQuery:
    """Appends units and rejected books of every new file to Parquet tables under target.

    Each micro-batch is written under its own number and overwritten if it is run again after a failure, so every file
    counts once. trigger: as of DataStreamWriter.trigger, for instance availableNow=True.
    """

    def write(batch: DataFrame, number: int) -> None:
        corpus = Corpus.from_files(batch.select("path", "content"), options)
        corpus.units("all").write.mode("overwrite").parquet(f"{target}/units/batch={number}")
        corpus.rejected.write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(folder)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
