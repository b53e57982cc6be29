"""Queries of the collection: upserts, deletes, lists, paging and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import retrieval as R
from ..operators import store as S
from ..staging import fresh_path, short_batches, staged
from .q_retrieval import POINTS, points
from .registry import Tables, query


def stored(t: Tables) -> DataFrame:
    return points(t).select(F.col("label").alias("book_id"), F.col("vec_id").alias("chunk_index"), "embedding", "is_metadata", F.when(F.col("is_metadata"), F.concat(F.lit("Book "), F.col("label").cast("string"))).alias("title"))


@query("points_union", f"WITH {POINTS} SELECT label AS book_id, vec_id AS chunk_index, is_metadata, 'Title ' || label AS title FROM points")
def points_union(t: Tables) -> DataFrame:
    own = stored(t)
    books = own.filter("is_metadata").select("book_id", "chunk_index", F.concat(F.lit("Title "), F.col("book_id").cast("string")).alias("title"))
    return S.points(own.filter("NOT is_metadata").select("book_id", "chunk_index"), books).select("book_id", "chunk_index", "is_metadata", "title")


@query("points_replace", "SELECT label AS book_id, vec_id + CASE WHEN label IN (2, 4) THEN 1000000 ELSE 0 END AS chunk_index FROM embeddings WHERE label NOT IN (2, 4) OR vec_id % 2 = 0")
def points_replace(t: Tables) -> DataFrame:
    own = stored(t).select("book_id", "chunk_index")
    fresh = own.filter("book_id IN (2, 4) AND chunk_index % 2 = 0").withColumn("chunk_index", F.col("chunk_index") + 1000000)
    return S.replaced(own, fresh)


@query("points_delete", "SELECT label AS book_id, vec_id AS chunk_index FROM embeddings WHERE label NOT IN (0, 9)")
def points_delete(t: Tables) -> DataFrame:
    return S.without_books(stored(t), [0, 9]).select("book_id", "chunk_index")


@query("collection_writes", "SELECT label::VARCHAR AS book_id, vec_id::INT AS chunk_index, CASE WHEN label = 2 THEN 'second' ELSE 'first' END AS content FROM embeddings WHERE label <> 4 AND (label <> 2 OR vec_id % 2 = 0) UNION ALL SELECT '4', vec_id::INT, 'back' FROM embeddings WHERE label = 4 AND vec_id % 3 = 0")
def collection_writes(t: Tables) -> DataFrame:
    """A collection after a series of writes: all points, one book replaced, one deleted, compacted, and the deleted one written again."""
    held = S.Collection(t.spark, fresh_path(t.spark, "collection"))
    rows = lambda df, said: df.select(F.col("label").cast("string").alias("book_id"), F.col("vec_id").cast("int").alias("chunk_index"), F.lit(said).alias("content"), F.lit(False).alias("is_metadata"))
    held.upsert(rows(t.embeddings, "first"))
    held.upsert(rows(t.embeddings.filter("label = 2 AND vec_id % 2 = 0"), "second"))
    held.delete("4")
    held.compact()
    held.upsert(rows(t.embeddings.filter("label = 4 AND vec_id % 3 = 0"), "back"))
    return held.read().select("book_id", "chunk_index", "content")


@query("collection_lookup", "SELECT vec_id::INT AS chunk_index FROM embeddings WHERE label = 3 AND vec_id % 2 = 1 ORDER BY vec_id LIMIT 20 OFFSET 10")
def collection_lookup(t: Tables) -> DataFrame:
    """A page of one chapter of a book: only files that may hold the book are opened."""
    held = S.Collection(t.spark, fresh_path(t.spark, "collection"))
    held.upsert(t.embeddings.select(F.col("label").cast("string").alias("book_id"), F.col("vec_id").cast("int").alias("chunk_index"), (F.col("vec_id") % 2).cast("int").alias("chapter_number"), F.lit(False).alias("is_metadata")))
    return S.scroll(held.read(["3"]), "3", 20, 10, chapter=1).select("chunk_index")


@query("point_lookup", f"WITH {POINTS} SELECT label AS book_id, vec_id AS chunk_index, 'Book ' || label AS title FROM points WHERE is_metadata AND label = 4")
def point_lookup(t: Tables) -> DataFrame:
    return S.lookup(stored(t), 4).select("book_id", "chunk_index", "title")


@query("books_list", f"WITH {POINTS} SELECT label AS book_id, 'Book ' || label AS title FROM points WHERE is_metadata ORDER BY title, book_id LIMIT 1000")
def books_list(t: Tables) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    own = stored(t).withColumns({"authors": none, "genres": none, "tags": none, "difficulty_level": F.lit(None).cast("string")})
    return S.book_list(own).select("book_id", "title")


@query("books_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def books_page(t: Tables) -> DataFrame:
    return R.page(t.customer.select("c_custkey", "c_name"), 3, 20, "c_name", "c_custkey")


@query("books_page_after", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def books_page_after(t: Tables) -> DataFrame:
    """The third page, each found from where the one before ended, with the total."""
    books, page = t.customer.select("c_custkey", "c_name"), None
    for _ in range(3):
        page = R.page_after(books, 20, page and page.last, "c_name", "c_custkey")
    return page.rows.withColumn("total", F.lit(page.total).cast("long"))


@query("page_total", "SELECT c_mktsegment, count(*) AS total FROM customer GROUP BY c_mktsegment")
def page_total(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("total"))


@query("book_scroll", f"WITH {POINTS} SELECT vec_id AS chunk_index FROM points WHERE label = 3 AND NOT is_metadata ORDER BY vec_id LIMIT 20 OFFSET 10")
def book_scroll(t: Tables) -> DataFrame:
    return S.scroll(stored(t), 3, 20, 10).select("chunk_index")


@query("collection_stats", f"WITH {POINTS} SELECT count(*) AS points_count, count(embedding) AS vectors_count, count(*) FILTER (is_metadata) AS total_books, count(*) FILTER (NOT is_metadata) AS total_chunks, 'green' AS status FROM points")
def collection_stats(t: Tables) -> DataFrame:
    return S.info(stored(t))


@query("book_card", "SELECT p_partkey, 'Title: ' || p_name || chr(10) || 'Authors: ' || p_brand || ', ' || p_type || chr(10) || 'Summary: ' || chr(10) || 'Topics: ' || p_type || chr(10) || 'Tags: ' || replace(p_name, ' ', ', ') AS card FROM part")
def book_card(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.lit(None).cast("string").alias("summary"), F.array("p_type").alias("main_topics"), F.split("p_name", " ").alias("tags"))
    return S.book_card(rows).select("p_partkey", "card")


FILES = "files AS (SELECT event_id, 'dir/' || event_type || '/File' || lpad(event_id::VARCHAR, 9, '0') || '.epub' AS path, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, user_id FROM events)"


def files(t: Tables) -> DataFrame:
    name = F.concat(F.lit("File"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".epub"))
    return t.events.select("event_id", F.concat(F.lit("dir/"), "event_type", F.lit("/"), name).alias("path"), name.alias("file_name"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), "user_id", F.concat(F.lit("bad "), F.col("event_id").cast("string")).alias("error"))


@query("discover_sorted", f"WITH {FILES} SELECT path, row_number() OVER (ORDER BY lower(list_last(string_split(path, '/'))), path) AS place FROM files ORDER BY place LIMIT 100")
def discover_sorted(t: Tables) -> DataFrame:
    """The first 100 files of the order of discovery; the limit is the option max_files."""
    from pyspark.sql import Window

    first = B.remaining(files(t), t.spark.createDataFrame([], "path string, status string"), 100)
    return first.select("path", F.row_number().over(Window.orderBy(F.lower("file_name"), "path")).cast("long").alias("place"))


@query("discover_all", f"WITH {FILES}, n AS (SELECT lower(list_last(string_split(path, '/'))) AS name, path FROM files) SELECT path, row_number() OVER (ORDER BY name, path) AS place FROM n")
def discover_all(t: Tables) -> DataFrame:
    """The place of every file in the order of discovery, numbered by ranges of names: no task holds all of them."""
    return B.numbered(files(t)).select("path", "place")


@query("resume_anti_join", f"WITH {FILES} SELECT path FROM files WHERE event_id % 3 <> 0")
def resume(t: Tables) -> DataFrame:
    return B.remaining(files(t), files(t).filter("event_id % 3 = 0")).select("path")


@query("resume_retry_failed", f"WITH {FILES} SELECT path FROM files WHERE event_id % 3 <> 0 OR status = 'failed'")
def resume_retry(t: Tables) -> DataFrame:
    return B.remaining(files(t), files(t).filter("event_id % 3 = 0"), retry_failed=True).select("path")


@query("batch_progress", f"WITH {FILES} SELECT user_id, count(*) AS processed_files, count(*) FILTER (status <> 'failed') AS successful_files, count(*) FILTER (status = 'failed') AS failed_files, round(count(*) * 100.0 / 50, 6)::DOUBLE AS percent, round(count(*) / 600.0::DOUBLE * 60, 6) AS files_per_minute FROM files GROUP BY user_id")
def batch_progress(t: Tables) -> DataFrame:
    found = B.with_rates(B.counters(files(t), ["user_id"]), F.lit(50), F.lit(600.0))
    return found.select("user_id", "processed_files", "successful_files", "failed_files", F.round("percent", 6).cast("double").alias("percent"), F.round("files_per_minute", 6).alias("files_per_minute"))


@query("batch_errors", f"WITH {FILES} SELECT path, 'bad ' || event_id AS error FROM files WHERE status = 'failed'")
def batch_errors(t: Tables) -> DataFrame:
    return B.errors(files(t))


@query("batch_positions", "SELECT page_id, '[' || row_number() OVER (ORDER BY lower(url), url) || '/' || count(*) OVER () || ']' AS mark FROM pages")
def batch_positions(t: Tables) -> DataFrame:
    """The mark of every page in the order of urls; pages of one url, whose order the SQL leaves open, go by page_id."""
    return B.positions(t.pages.select("page_id", F.col("url").alias("path"), F.col("url").alias("file_name")), ("page_id",)).select("page_id", "mark")


@query("batch_summary", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) AS seconds, coalesce(string_agg('File' || lpad(event_id::VARCHAR, 9, '0') || '.epub', '|' ORDER BY event_id) FILTER (event_type = 'error'), '') AS failed_files FROM events GROUP BY user_id")
def batch_summary(t: Tables) -> DataFrame:
    name = F.concat(F.lit("dir/File"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".epub"))
    progress = t.events.select("user_id", name.alias("path"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.date_trunc("second", "ts").alias("at"))
    return B.summary(progress, ["user_id"]).withColumn("failed_files", F.array_join("failed_files", "|"))


@query("web_hits")
def web_hits(t: Tables) -> DataFrame:
    """For every benchmark item as a question, the five pages that answer it best by their words."""
    from ..sources import markup
    from ..sources.web import TableSearch

    short_batches(t.spark)
    read = t.pages.select("page_id", "url", markup.html_parts(F.col("html")).alias("parts"))
    pages = staged(read.select("page_id", "parts.title", "url", "parts.text"), "pages")
    return TableSearch(pages).search_each(t.benchmark.select(F.col("item_id").alias("question"), "text"))
