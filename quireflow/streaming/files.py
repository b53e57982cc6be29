"""Resumable ingestion as a stream: Spark's checkpoint remembers which files are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[DataFrame, int], None], max_files: int = 0) -> StreamingQuery:
    """Give each batch of files not seen before to `ingest`, until there are none, and stop.

    Starting again with the same checkpoint takes up where the last run ended; `ingest` must be idempotent for a batch
    number, since a batch that failed half-way comes again.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[eE][pP][uU][bB],[pP][dD][fF]}")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
