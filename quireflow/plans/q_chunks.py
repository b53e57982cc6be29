"""Queries of chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as K
from .q_chapters import BOOK, CHAPTERS, chapters
from .registry import Tables, query

CHARS, STEP, LEAST = 1000, 800, 60
RAW = r"""cuts AS (SELECT lang, source, doc_id, number, content, unnest(range(0, greatest(ceil((length(content) - 1000) / 800.0), 0)::BIGINT + 1)) AS k, greatest(ceil((length(content) - 1000) / 800.0), 0)::BIGINT + 1 AS n_raw FROM chapters WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> ''),
    parts AS (SELECT * EXCLUDE content, regexp_replace(content[(k * 800 + 1):(k * 800 + 1000)], '^\s+|\s+$', '', 'g') AS content FROM cuts),
    chunks AS (SELECT *, length(content) // 4 AS tokens FROM parts WHERE content <> '' AND (length(content) // 4 >= 60 OR k = n_raw - 1))"""


def fixed(t: Tables) -> DataFrame:
    return K.fixed(chapters(t), [*BOOK, "doc_id", "number"], "content", CHARS, STEP, LEAST)


@query("chunk_fixed", f"WITH {CHAPTERS}, {RAW} SELECT doc_id, k::INT AS position, content, tokens::BIGINT AS token_count FROM chunks")
def chunk_fixed(t: Tables) -> DataFrame:
    return fixed(t).select("doc_id", "position", "content", "token_count")


@query("chunk_stats", f"WITH {CHAPTERS}, {RAW} SELECT count(*) AS total_chunks, sum(tokens)::BIGINT AS total_tokens, (sum(tokens) // count(*))::BIGINT AS avg_tokens, min(tokens)::BIGINT AS min_tokens, max(tokens)::BIGINT AS max_tokens FROM chunks")
def chunk_stats(t: Tables) -> DataFrame:
    return K.statistics(fixed(t))


@query("chunk_global_index", f"WITH {CHAPTERS}, {RAW} SELECT doc_id, k::INT AS position, (row_number() OVER (PARTITION BY lang, source, number ORDER BY k) - 1)::INT AS local_index, count(*) OVER (PARTITION BY lang, source, number) AS total_chunks, (row_number() OVER (PARTITION BY lang, source ORDER BY number, k) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY lang, source) AS total_document_chunks FROM chunks")
def chunk_index(t: Tables) -> DataFrame:
    return K.indexed(fixed(t), BOOK, "number").select("doc_id", "position", "local_index", "total_chunks", "chunk_index", "total_document_chunks")


@query("chunk_reassemble", f"WITH {CHAPTERS}, {RAW} SELECT doc_id, sha256(string_agg(content, chr(10) || chr(10) ORDER BY k)) AS content_sha256, count(*) AS n FROM chunks GROUP BY doc_id")
def reassemble(t: Tables) -> DataFrame:
    from ..functions import text as T

    return fixed(t).groupBy("doc_id").agg(F.sha2(T.ordered_concat(F.col("position"), F.col("content"), "\n\n"), 256).alias("content_sha256"), F.count(F.lit(1)).alias("n"))


@query("chunk_recursive")
def chunk_recursive(t: Tables) -> DataFrame:
    return K.recursive(t.documents, ["doc_id"], "text", 50, 200, 0.2)


@query("chunk_recursive_small")
def chunk_recursive_small(t: Tables) -> DataFrame:
    return K.recursive(t.documents, ["doc_id"], "text", 20, 80, 0.2)


@query("chunk_recursive_exact")
def chunk_recursive_exact(t: Tables) -> DataFrame:
    """Sizes as documented, with lengths rounded up."""
    return K.recursive(t.documents, ["doc_id"], "text", 50, 200, 0.2, compat=False)


@query("chunk_recursive_by_chapter")
def chunk_by_chapter(t: Tables) -> DataFrame:
    own = chapters(t).select(F.concat_ws("/", "lang", "source").alias("book_id"), "number", F.concat(F.lit("Chapter "), F.col("number").cast("string")).alias("title"), F.lit(0).alias("start_page"), F.lit(0).alias("end_page"), "content")
    books = own.groupBy("book_id").agg(F.lit(None).cast("string").alias("raw_text"))
    return K.chunk_books(books, own, min_tokens=50, max_tokens=200).select("book_id", "chapter_number", "chunk_index", "local_index", "total_chunks", "total_document_chunks", "token_count", "content")


@query(
    "chunk_with_images",
    f"WITH {CHAPTERS}, {RAW}, c AS (SELECT *, (number - 1) * 2 + 1 AS s, (number - 1) * 2 + 2 AS e FROM chunks), img AS (SELECT split_part(url, '/', 4) AS lang, 'src' || (page_id % 20) AS source, page_id AS ord, page_id % 12 AS p, '[PHOTO] ' || url AS line FROM pages), "
    "l AS (SELECT c.doc_id, count(i.ord) AS n_images, string_agg(i.line, chr(10) || chr(10) ORDER BY i.p, i.ord) AS images FROM (SELECT DISTINCT lang, source, doc_id, s, e FROM c) c JOIN img i ON i.lang = c.lang AND i.source = c.source AND i.p <> 0 AND i.p BETWEEN c.s AND c.e GROUP BY c.doc_id) "
    "SELECT c.doc_id, c.k::INT AS position, coalesce(l.n_images, 0) AS n_images, sha256(c.content || CASE WHEN l.images IS NULL THEN '' ELSE chr(10) || chr(10) || '[Image Context]' || chr(10) || l.images END) AS content_sha256 FROM c LEFT JOIN l ON l.doc_id = c.doc_id",
)
def chunk_with_images(t: Tables) -> DataFrame:
    from ..operators import chapters as C

    chunks = fixed(t).withColumn("start_page", (F.col("number") - 1) * 2 + 1).withColumn("end_page", (F.col("number") - 1) * 2 + 2)
    images = t.pages.select(F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"), F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("source"), F.col("page_id").alias("ord"), (F.col("page_id") % 12).cast("int").alias("page_number"), F.lit("photo").alias("image_type"), F.col("url").alias("description"), F.lit("").alias("ocr_text"))
    return C.with_images(chunks, images, BOOK).select("doc_id", "position", "n_images", F.sha2("content", 256).alias("content_sha256"))
