"""Every query by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of Tables as a query; without SQL it is held against brute force in the tests."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


from . import q_analysis, q_chapters, q_chunks, q_retrieval, q_serving, q_store, q_text  # noqa: E402, F401
