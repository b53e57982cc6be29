"""Queries of chapters, contents, page ranges and images; a book is a language and source, a chapter a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chapters as C
from .registry import Tables, query

BOOK = ["lang", "source"]
CHAPTERS = "chapters AS (SELECT lang, source, doc_id, text AS content, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS number FROM documents)"


def chapters(t: Tables) -> DataFrame:
    return C.numbered(t.documents.withColumnRenamed("text", "content"), BOOK, "doc_id")


@query("chapter_number_min_len", r"SELECT doc_id, (row_number() OVER (PARTITION BY lang, source ORDER BY doc_id))::INT AS number FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100")
def chapter_number(t: Tables) -> DataFrame:
    return C.numbered(t.documents.withColumnRenamed("text", "content"), BOOK, "doc_id", 100).select("doc_id", "number")


@query("chapter_title_clip", r"WITH " + CHAPTERS + r", h AS (SELECT doc_id, number, regexp_replace(string_split(content, chr(10))[1], '^\s+|\s+$', '', 'g') AS t FROM chapters) SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR t = '' THEN 'Chapter ' || number WHEN length(t) <= 200 THEN t ELSE t[1:200] || '...' END AS title FROM h")
def chapter_title(t: Tables) -> DataFrame:
    heading = F.when(F.col("doc_id") % 5 != 0, F.split("content", "\n")[0])
    return C.titled(chapters(t).withColumn("title", heading)).select("doc_id", "title")


@query("book_raw_text", "WITH " + CHAPTERS + r", b AS (SELECT lang, source, string_agg(content, chr(10) || chr(10) ORDER BY number) AS raw_text FROM chapters GROUP BY lang, source) SELECT lang, source, sha256(raw_text) AS raw_sha256, length(raw_text)::BIGINT AS n_chars, len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> ''))::BIGINT AS word_count FROM b")
def book_raw_text(t: Tables) -> DataFrame:
    return C.raw_text(chapters(t), BOOK).select(*BOOK, F.sha2("raw_text", 256).alias("raw_sha256"), F.length("raw_text").cast("long").alias("n_chars"), "word_count")


@query("book_raw_parts", "WITH " + CHAPTERS + r", n AS (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY lang, source ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM chapters), b AS (SELECT lang, source, string_agg(content, chr(10) || chr(10) ORDER BY number) AS raw_text FROM chapters GROUP BY lang, source) SELECT lang, source, number, start, sha256(raw_text[start + 1:start + length(content)]) AS part_sha256, length(raw_text)::BIGINT AS n_chars, len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> ''))::BIGINT AS word_count FROM n JOIN b USING (lang, source)")
def book_raw_parts(t: Tables) -> DataFrame:
    """Every chapter where it stands in its book, and the counts of the whole book, without putting the book together."""
    return C.raw_parts(chapters(t), BOOK).select(*BOOK, "number", "start", F.sha2("content", 256).alias("part_sha256"), "n_chars", "word_count")


#: Pages are a book's documents; every third one begins a contents entry, of levels 1, 2 and 3 in turn.
TOC = (
    CHAPTERS.replace("chapters AS", "pages_ AS").replace("AS number", "AS page")
    + ", toc AS (SELECT lang, source, page, (page // 3)::INT AS seq, ((page // 3) % 3 + 1)::INT AS level, 'Part ' || page AS title FROM pages_ WHERE page % 3 = 1 AND source <> 'src1')"
    + ", n AS (SELECT lang, source, max(page) AS n_pages FROM pages_ GROUP BY lang, source)"
    + ", ranges AS (SELECT t.*, t.page AS start_page, coalesce(lead(t.page) OVER (PARTITION BY t.lang, t.source ORDER BY t.seq) - 1, n.n_pages) AS end_page FROM toc t JOIN n ON n.lang = t.lang AND n.source = t.source)"
)


def paged(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = t.documents.withColumn("page", F.row_number().over(Window.partitionBy(*BOOK).orderBy("doc_id"))).select(*BOOK, "page", "text")
    seq = F.floor(F.col("page") / 3).cast("int")
    toc = pages.filter("page % 3 = 1 AND source <> 'src1'").select(*BOOK, "page", seq.alias("seq"), (seq % 3 + 1).alias("level"), F.concat(F.lit("Part "), F.col("page").cast("string")).alias("title"))
    return pages, toc, pages.groupBy(*BOOK).agg(F.max("page").alias("n_pages"))


@query("toc_page_ranges", "WITH " + TOC + " SELECT lang, source, seq, level, title, start_page::INT AS start_page, end_page::INT AS end_page FROM ranges")
def toc_ranges(t: Tables) -> DataFrame:
    _, toc, books = paged(t)
    return C.page_ranges(toc, books, BOOK).select(*BOOK, "seq", "level", "title", "start_page", "end_page")


@query(
    "toc_chapter_text",
    "WITH " + TOC + r""", texts AS (SELECT r.lang, r.source, r.seq, r.title, r.start_page, r.end_page, string_agg(p.content, chr(10) ORDER BY p.page) AS content FROM ranges r JOIN pages_ p ON p.lang = r.lang AND p.source = r.source AND p.page BETWEEN r.start_page AND r.end_page WHERE r.level <= 2 GROUP BY ALL)
    SELECT lang, source, (row_number() OVER (PARTITION BY lang, source ORDER BY seq))::INT AS number, title, start_page::INT AS start_page, end_page::INT AS end_page, sha256(content) AS content_sha256 FROM texts WHERE length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 50""",
)
def toc_chapters(t: Tables) -> DataFrame:
    pages, toc, books = paged(t)
    return C.chapter_pages(C.page_ranges(toc, books, BOOK), pages, BOOK).select(*BOOK, "number", "title", "start_page", "end_page", F.sha2("content", 256).alias("content_sha256"))


@query("no_toc_full_document", "WITH " + TOC + " SELECT p.lang, p.source, 'Full Document' AS title, 1 AS number, 1 AS start_page, count(*) AS end_page, sha256(string_agg(p.content, chr(10) ORDER BY p.page)) AS content_sha256 FROM pages_ p ANTI JOIN toc ON toc.lang = p.lang AND toc.source = p.source GROUP BY p.lang, p.source")
def no_toc(t: Tables) -> DataFrame:
    pages, toc, _ = paged(t)
    return C.whole_books(pages, toc, BOOK).select(*BOOK, "title", "number", "start_page", "end_page", F.sha2("content", 256).alias("content_sha256"))


@query("image_filter", "SELECT l_orderkey, l_linenumber, l_quantity::INT * 2 AS width, (l_partkey % 100)::INT AS height FROM lineitem WHERE l_quantity::INT * 2 >= 50 AND l_partkey % 100 >= 50")
def image_filter(t: Tables) -> DataFrame:
    sized = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * 2).alias("width"), (F.col("l_partkey") % 100).cast("int").alias("height"))
    return C.large_images(sized)


@query("image_dedup_first_page", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) = 1")
def image_dedup(t: Tables) -> DataFrame:
    return C.first_pages(t.lineitem, "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query(
    "chunk_images_by_page",
    "WITH " + CHAPTERS + """, c AS (SELECT lang, source, number, (number - 1) * 2 + 1 AS s, (number - 1) * 2 + 2 AS e, doc_id FROM chapters),
    img AS (SELECT split_part(url, '/', 4) AS lang, 'src' || (page_id % 20) AS source, page_id AS ord, page_id % 12 AS p, '[PHOTO] ' || url AS line FROM pages)
    SELECT c.doc_id, count(i.ord) AS n_images, coalesce(string_agg(i.line, chr(10) || chr(10) ORDER BY i.p, i.ord), '') AS images FROM c LEFT JOIN img i ON i.lang = c.lang AND i.source = c.source AND i.p <> 0 AND i.p BETWEEN c.s AND c.e GROUP BY c.doc_id""",
)
def chunk_images(t: Tables) -> DataFrame:
    own = chapters(t).withColumn("start_page", (F.col("number") - 1) * 2 + 1).withColumn("end_page", (F.col("number") - 1) * 2 + 2)
    images = t.pages.select(F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"), F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("source"), F.col("page_id").alias("ord"), (F.col("page_id") % 12).cast("int").alias("page_number"), F.lit("photo").alias("image_type"), F.col("url").alias("description"), F.lit("").alias("ocr_text"))
    return C.with_images(own, images, BOOK).select("doc_id", "n_images", F.coalesce("images", F.lit("")).alias("images"))


@query("toc_rendering", "SELECT o_custkey, string_agg(repeat('  ', (o_orderkey % 3)::INT) || '- ' || CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown' ELSE 'Order ' || o_orderkey END, chr(10) ORDER BY o_orderkey) AS toc FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 30 GROUP BY o_custkey")
def toc_rendering(t: Tables) -> DataFrame:
    ranked = t.orders.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("rn <= 30")
    entry = F.struct("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("level"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("title"))
    return ranked.groupBy("o_custkey").agg(T.toc_lines(F.array_sort(F.collect_list(entry)), indent=True).alias("toc"))


@query("image_summary", "SELECT label AS book_id, string_agg('Image ' || (vec_id + 1) || ' (photo): item ' || vec_id, chr(10) ORDER BY vec_id) AS summary FROM embeddings GROUP BY label")
def image_summary(t: Tables) -> DataFrame:
    images = t.embeddings.select(F.col("label").alias("book_id"), F.col("vec_id").alias("ord"), F.lit("photo").alias("image_type"), F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("description"))
    return C.image_summary(images, ["book_id"])


@query("metadata_lines", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'No metadata available' ELSE 'title: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE chr(10) || 'publisher: ' || c_mktsegment END END AS lines FROM customer")
def metadata_lines(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    values = {"title": F.when(key % 4 != 0, F.col("c_name")), "date": F.lit(""), "publisher": F.when(key % 2 != 0, F.col("c_mktsegment"))}
    return t.customer.select("c_custkey", T.metadata_lines(values).alias("lines"))
