"""Exact filtered top-k over embedded points, and what is built on it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.filters import matching
from ..functions.vector import cosine, query_vector


def scored(points: DataFrame, query: list[float] | Column, filters: dict | None = None, vector: str = "embedding") -> DataFrame:
    """The points that match the filters, with their cosine similarity to the query as `score`."""
    if isinstance(query, (list, tuple)):
        score = cosine(F.col(vector), query_vector(query), F.lit(float(np.sqrt(sum(x * x for x in map(float, query))))))
    else:
        score = cosine(F.col(vector), query)
    return matching(points, filters).withColumn("score", score)


def top_k(points: DataFrame, query: list[float] | Column, k: int = 10, filters: dict | None = None, key: str | tuple[str, ...] = "chunk_index", vector: str = "embedding") -> DataFrame:
    """The k best points of those that match, best first; ties by key. Each partition keeps k rows, and only those meet."""
    ties = [key] if isinstance(key, str) else key
    return scored(points, query, filters, vector).orderBy(F.col("score").desc(), *ties).limit(k)


#: Rows of a block of points and of a block of questions that meet in one task, and scores that are held at once there.
POINTS_AT_ONCE, QUESTIONS_AT_ONCE, SCORES_AT_ONCE = 1 << 14, 1 << 12, 1 << 21


def best_of_blocks(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of a pair of blocks, points (key, v) and questions (question, w): the k best points of each question."""

    def unit(rows: pa.Table, name: str) -> np.ndarray:
        flat = rows[name].combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(np.float64)
        size = np.linalg.norm(values, axis=1, keepdims=True)
        return np.divide(values, size, out=np.zeros_like(values), where=size > 0)

    def best(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("question", pa.int64()), ("key", pa.int64()), ("score", pa.float64()))})
        p = p.sort_by("key")  # of equal scores the smaller key is first
        keys, asked = p["key"].to_numpy(), q["question"].to_numpy()
        points, questions = unit(p, "v").T, unit(q, "w")
        n, step = min(k, len(keys)), max(1, SCORES_AT_ONCE // len(keys))
        out = {"question": [], "key": [], "score": []}
        for first in range(0, len(asked), step):
            score = questions[first : first + step] @ points
            near = np.round(score, 12)
            # whatever is as good as the n-th best counts, then ties go by key
            least = np.partition(near, len(keys) - n, axis=1)[:, len(keys) - n]
            for i in range(len(near)):
                fit = np.flatnonzero(near[i] >= least[i])
                fit = fit[np.argsort(-near[i, fit], kind="stable")[:n]]
                out["question"].append(np.full(n, asked[first + i]))
                out["key"].append(keys[fit])
                out["score"].append(score[i, fit])
        return pa.table({c: np.concatenate(v) for c, v in out.items()})

    return best


def top_k_each(points: DataFrame, questions: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(question, key, score, rank): the k best points of every question (question, vector), ties by key, for long tables of both.

    Both tables are dealt into blocks of bounded size; every block of points meets every block of questions as products of
    matrices, a slice of the questions at a time, and only the k best of a question leave a pair of blocks. So a task's memory
    doesn't grow with the tables. Keys are integers; rows without a vector count on neither side.
    """
    n_points, n_questions = (max(1, -(-df.count() // most)) for df, most in ((points, POINTS_AT_ONCE), (questions, QUESTIONS_AT_ONCE)))
    dealt = lambda df, name, n: F.pmod(F.xxhash64(df[name]), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = points.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), dealt(points, key, n_points).alias("p_block")).withColumn("q_block", every(n_questions))
    q = questions.filter(F.col(vector).isNotNull()).select(F.col("question").cast("long").alias("question"), F.col(vector).alias("w"), dealt(questions, "question", n_questions).alias("q_block")).withColumn("p_block", every(n_points))

    found = p.groupBy("p_block", "q_block").cogroup(q.groupBy("p_block", "q_block")).applyInArrow(best_of_blocks(k), "question long, key long, score double")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.round("score", 12).desc(), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("key", key)


def books_only(points: DataFrame) -> DataFrame:
    return points.filter("is_metadata")


def chunks_only(points: DataFrame) -> DataFrame:
    return points.filter("NOT is_metadata")


def best_title(points: DataFrame, query: list[float], least: float = 0.7, key: str = "book_id", vector: str = "embedding") -> DataFrame:
    """The best book, if its score is over `least`, or no row."""
    return top_k(books_only(points), query, 1, key=key, vector=vector).filter(F.col("score") > least)


def results(found: DataFrame) -> DataFrame:
    """Search results with empty strings for what a point doesn't have."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.select("score", blank("content"), blank("book_id"), blank("title"), "chunk_index", "chapter_title")


def cited(found: DataFrame, key: str) -> DataFrame:
    """Hits numbered from 1 by rank; meant for the few rows of a top-k, which is why one window may hold them."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key))).withColumn("mark", F.format_string("[%d]", "rank"))


def hybrid(points: DataFrame, query: list[float], words: list[str], weight: float = 0.1, k: int = 10, text: str = "content", key: str = "chunk_index") -> DataFrame:
    """Extension: cosine plus a bonus for each query word that the text holds."""
    held = sum((F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return scored(points, query).withColumn("score", F.col("score") + weight * held).orderBy(F.col("score").desc(), key).limit(k)


def reranked(found: DataFrame, chosen: DataFrame, key: str = "book_id") -> DataFrame:
    """The candidates that a model chose, in its order: chosen has (key, rank)."""
    return found.join(chosen.select(key, F.col("rank").alias("chosen_rank")), key).orderBy("chosen_rank")


def recommended(points: DataFrame, query: list[float] | Column, k: int, tags: list[str] | None = None, chosen: DataFrame | None = None, key: str = "book_id", vector: str = "embedding") -> DataFrame:
    """The k books that a reader is shown: twice as many candidates by similarity, of those with any of the tags, then the model's choice.

    chosen has (key, rank) from a model that read the candidates; without it the candidates' own order counts.
    """
    candidates = top_k(books_only(points), query, 2 * k, {"tags": tags} if tags else None, key, vector)
    if chosen is not None:
        return reranked(candidates, chosen, key).limit(k)
    return candidates.orderBy(F.col("score").desc(), key).limit(k)


def wanted_tags(message: str, known: list[str]) -> list[str]:
    """Known tags that a message names as whole words: what a recommendation is filtered by."""
    words = set(re.findall(r"[^\W_]+", message.lower()))
    return [t for t in known if set(re.findall(r"[^\W_]+", t.lower())) and set(re.findall(r"[^\W_]+", t.lower())) <= words]


def page(books: DataFrame, number: int, size: int, by: str = "title", key: str = "book_id") -> DataFrame:
    """One page of a list in a total order."""
    return books.orderBy(by, key).offset((number - 1) * size).limit(size)


@dataclass
class Page:
    """Rows of a page, how many the whole list has, and the place of the last row, from which the next page goes on."""

    rows: DataFrame
    total: int
    last: tuple | None


def page_after(books: DataFrame, size: int, after: tuple | None = None, by: str = "title", key: str = "book_id") -> Page:
    """The page behind a place (by, key) in a total order, nulls first; the first one without a place.

    Rows up to the place are left out, not sorted and counted as with an offset, so a late page costs what the first does. The
    total is counted while the page is found.
    """
    seen = Observation()
    listed = books.observe(seen, F.count(F.lit(1)).alias("total"))
    if after is not None:
        place = F.struct(*[F.lit(v).cast(books.schema[c].dataType).alias(c) for c, v in zip((by, key), after, strict=True)])
        listed = listed.filter(F.struct(by, key) > place)
    found = listed.orderBy(by, key).limit(size).toArrow()  # `size` rows
    last = tuple(found[c][-1].as_py() for c in (by, key)) if found.num_rows else None
    return Page(books.sparkSession.createDataFrame(found, books.schema), seen.get["total"], last)


#: What a message holds that asks for more than a library has.
WEB_WORDS = ("latest", "recent", "news", "current", "2024", "2025", "what is", "how to", "tutorial", "guide")


def needs_web(message: Column, best: Column, least: float = 0.5) -> Column:
    """Whether to look on the web: the message holds one of the words, or the library's best score (null: no hit) is too low."""
    low = F.lower(message)
    asks = reduce(or_, [F.contains(low, F.lit(w)) for w in WEB_WORDS])
    return F.coalesce(asks, F.lit(False)) | (F.coalesce(best, F.lit(0.0)) < least)


def general_context(library: DataFrame, web: DataFrame, message: Column, least: float = 0.5) -> DataFrame:
    """Library hits, and web hits only where the gate lets them in. library has a `score`; both are the few rows of a search."""
    gate = library.agg(F.max("score").alias("best")).select(needs_web(message, F.col("best"), least).alias("open"))
    return context(library, web.join(gate.filter("open"), how="left_semi"))


def context(library: DataFrame, web: DataFrame) -> DataFrame:
    """Library hits and web hits in one table, told apart by `source`."""
    return library.withColumn("source", F.lit("library")).unionByName(web.withColumn("source", F.lit("web")), allowMissingColumns=True)


def passages(found: DataFrame, limit: int = 300) -> DataFrame:
    return found.withColumn("matched_content", F.substring("content", 1, limit)).withColumn("content_preview", T.preview(F.col("content"), 100))
