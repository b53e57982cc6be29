"""Embeddings as a column: a model loaded once in each worker, texts in batches."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import short_batches


class Embedder(Protocol):
    """Makes vectors of one dimension. It travels to the workers, so heavy state belongs into load()."""

    dimension: int

    def load(self) -> None: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic embedder without a model: signed word hashes, scaled to length 1; a blank text is all zeros."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def load(self) -> None:
        pass

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            held = Counter(text.lower().split())
            if held:
                h = np.fromiter((zlib.crc32(word.encode()) for word in held), np.int64, len(held))
                n = np.fromiter(held.values(), np.float64, len(held))
                out[i] = np.bincount(h % self.dimension, np.where(h >> 31, n, -n), self.dimension)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def embed(text: Column, embedder: Embedder, batch_size: int = 32) -> Column:
    """array<float> of a text column; null counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder.load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [embedder.embed(texts[k : k + batch_size]) for k in range(0, len(texts), batch_size)]
            yield pd.Series([v for part in parts for v in part], dtype=object)

    return run(text)


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: str = "content", batch_size: int = 32) -> DataFrame:
    short_batches(chunks.sparkSession)
    return chunks.withColumn("embedding", embed(F.col(text), embedder, batch_size))


def embed_query(text: str, embedder: Embedder) -> list[float]:
    """The vector of a query, on the driver, by the same way as texts and without a prefix."""
    embedder.load()
    return [float(x) for x in embedder.embed([text])[0]]


def joined(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks with vectors from a table, one for each, or an error for a chunk without one."""
    both = chunks.join(vectors.select(key, "embedding"), key, "left")
    return both.withColumn("embedding", F.coalesce("embedding", F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string"))).cast("array<float>")))
