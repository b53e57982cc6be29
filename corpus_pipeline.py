"""From documents to training sequences: five stages, each one written as Parquet and read again by the next.

Every row of documents is a document of its own, also one without an id and one that repeats another's id or all of its
columns. A null text counts as empty; texts are read whole; an empty table goes through as an empty table. The first four
stages give back all columns they got, whatever their names, in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import minhash, packing, quality, secrets, toxicity
from quireflow.llm.common import sieved, staged, table
from quireflow.llm.queries import tokenizer_path

#: Training sequences have at most so many ids.
CAPACITY = 2048
#: The key of a row while near-duplicates are sought.
ROW = "__row"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model is fitted on the labelled ones among docs.

    Null, empty and blank texts aren't toxic. Repeated rows stay or go together. Without labels nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule or whose compression is out of its band go.

    Null, empty and blank texts have too few words and go. Repeated rows stay or go together, whatever their ids.
    """
    return quality.passing(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest doc_id, a null last; of equal ids any one.

    Rows are told apart by a key of their own, so rows without an id and repeated rows are documents like others; of rows that
    repeat a text one stays. Texts without a word are duplicates of nothing, and all stay.
    """
    keyed = staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    found = minhash.near_duplicates(keyed, id_col=ROW, width=5, percent=80).join(keyed.select(ROW, "doc_id"), ROW)
    found = staged(found.select(ROW, "doc_id", "component_id"), "found")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}"))
    gone = staged(found.select(ROW).join(kept, ROW, "left_anti"), "gone")
    marked = sieved(keyed, ROW, gone)  # most rows stay, and stay where they are; only those that may go meet the keys that do
    return marked.filter("NOT __maybe").union(marked.filter("__maybe").join(gone, ROW, "left_anti").select(marked.columns)).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the secret scan finds is replaced by a mark, and n_chars follows the text (null for a null text)."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence; a null id is kept, a text without tokens is its end alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality_rules", with_quality),
    ("near_duplicates", without_near_duplicates),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Hashing, compression, entropy windows and bitset packing have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
