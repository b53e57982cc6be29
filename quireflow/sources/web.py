"""Hits from the web: the interface that a search service would fill, and one that answers from a table."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keywords import KeywordIndex
from ..staging import fresh_path

HIT = "title string, url string, snippet string, source string"
HITS = 5


class WebSearch(Protocol):
    """Answers a query with HITS rows of HIT at most."""

    def search(self, query: str) -> DataFrame: ...


class TableSearch:
    """A search over a table (page_id, title, url, text): BM25 over whole words, ties by page_id. The index is built once, at the first question."""

    def __init__(self, pages: DataFrame, source: str = "table"):
        self.pages, self.source = pages, source
        self._index: KeywordIndex | None = None

    def search_each(self, questions: DataFrame) -> DataFrame:
        """(question, rank, title, url, snippet, source) for a table of questions (question, text)."""
        spark = self.pages.sparkSession
        if self._index is None:
            self._index = KeywordIndex(spark, fresh_path(spark, "web"), "page_id").build(self.pages)
        best = self._index.search_each(questions, HITS)
        shown = self.pages.select("page_id", "title", "url", F.substring("text", 1, 200).alias("snippet"))  # cut before rows move
        return best.join(shown, "page_id").select("question", "rank", "title", "url", "snippet", F.lit(self.source).alias("source"))

    def search(self, query: str) -> DataFrame:
        asked = self.pages.sparkSession.createDataFrame([(0, query)], "question long, text string")
        return self.search_each(asked).orderBy("rank").drop("question", "rank")
