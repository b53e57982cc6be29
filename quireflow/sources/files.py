"""Books as files: discovery, dispatch by extension, and content-addressed identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = {".epub": "epub", ".pdf": "pdf"}


def discover(spark: SparkSession, folder: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """Supported files of a folder in the order of their lower-cased names; extensions in either case.

    Contents are only read if asked for, and then files come in any order: bytes aren't sorted. A folder that isn't there is an error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{[eE][pP][uU][bB],[pP][dD][fF]}").load(folder)
    names = found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), T.extension(F.col("path")).alias("ext"), "length", *["content"] * content)
    return names if content else names.orderBy(F.lower("file_name"), "path")


def identified(files: DataFrame) -> DataFrame:
    """Adds file_hash and book_id, from the bytes of the file."""
    return files.withColumn("file_hash", F.sha2("content", 256)).withColumn("book_id", F.substring("file_hash", 1, 16))


def dispatched(files: DataFrame) -> DataFrame:
    """Adds document_type by extension, null for a file that no reader takes."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return files.withColumn("document_type", F.try_element_at(kind, T.extension(F.col("path"))))


def can_extract(path: str, kind: str) -> bool:
    return KINDS.get("." + path.rpartition(".")[2].lower()) == kind
