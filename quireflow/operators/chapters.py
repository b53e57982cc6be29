"""Books from chapters and pages: numbering, tables of contents, page ranges and texts in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def numbered(chapters: DataFrame, book: list[str], order: str, least_chars: int = 0) -> DataFrame:
    """Chapters of at least so many characters once stripped, numbered from 1 within their book by `order`; those without content go."""
    kept = chapters.filter(F.length(T.strip(F.col("content"))) >= least_chars) if least_chars else chapters.filter(F.col("content").isNotNull())
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(*book).orderBy(order)))


def titled(chapters: DataFrame, raw: str = "title") -> DataFrame:
    """A heading cut at 200 characters, or the chapter's number where there is none."""
    own = F.nullif(T.strip(F.col(raw)), F.lit(""))
    return chapters.withColumn("title", F.coalesce(T.clip(own, 200), F.concat(F.lit("Chapter "), F.col("number").cast("string"))))


def raw_text(chapters: DataFrame, book: list[str]) -> DataFrame:
    """One row for each book: its chapters in order with a blank line between, and how many words they are."""
    return chapters.groupBy(*book).agg(T.ordered_concat(F.col("number"), F.col("content"), "\n\n").alias("raw_text")).withColumn("word_count", T.word_count(F.col("raw_text")))


def raw_parts(chapters: DataFrame, book: list[str], separator: int = 2) -> DataFrame:
    """(book, number, start, content, n_chars, word_count): a book's text in parts, for books that are larger than a task.

    start is where a chapter begins in the text of the whole book, its chapters in order with `separator` characters in
    between; n_chars and word_count are those of the whole text. They are sums over a row for each chapter, so no list and
    no window holds a text. Words don't reach over the blank line between chapters.
    """
    sizes = chapters.select(*book, "number", F.length("content").alias("_chars"), T.word_count(F.col("content")).alias("_words"))
    whole, earlier = Window.partitionBy(*book), Window.partitionBy(*book).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *book, "number", F.coalesce(F.sum(F.col("_chars") + separator).over(earlier), F.lit(0)).cast("long").alias("start"),
        (F.sum(F.col("_chars") + separator).over(whole) - separator).cast("long").alias("n_chars"), F.sum("_words").over(whole).cast("long").alias("word_count"),
    )
    return chapters.select(*book, "number", "content").join(starts, [*book, "number"]).select(*book, "number", "start", "content", "n_chars", "word_count")


def page_ranges(toc: DataFrame, books: DataFrame, book: list[str]) -> DataFrame:
    """Contents entries with end_page: the page before the next entry of any level, or the book's last page.

    books has the page count as n_pages. Levels are filtered only afterwards, so a deep entry ends its chapter.
    """
    following = F.lead("page").over(Window.partitionBy(*book).orderBy("seq"))
    return toc.withColumn("next_page", following).join(books, book).select(*toc.columns, F.col("page").alias("start_page"), F.coalesce(F.col("next_page") - 1, F.col("n_pages")).alias("end_page"))


def chapter_pages(ranges: DataFrame, pages: DataFrame, book: list[str], most_level: int = 2, least_chars: int = 50) -> DataFrame:
    """Chapters of a contents list: the text of their pages, those up to a level and of some length, numbered.

    Each range becomes its pages, so the join with pages is an equi-join on book and page.
    """
    spread = ranges.filter((F.col("level") <= most_level) & (F.col("start_page") <= F.col("end_page"))).withColumn("page_at", F.explode(F.sequence("start_page", "end_page")))
    held = pages.select(*book, F.col("page").alias("page_at"), "text")
    texts = spread.join(held, [*book, "page_at"]).groupBy(*book, "seq", "title", "start_page", "end_page").agg(T.ordered_concat(F.col("page_at"), F.col("text"), "\n").alias("content"))
    return numbered(texts, book, "seq", least_chars)


def whole_books(pages: DataFrame, toc: DataFrame, book: list[str]) -> DataFrame:
    """One chapter with all pages for each book without contents."""
    alone = pages.join(toc.select(*book).distinct(), book, "left_anti")
    return alone.groupBy(*book).agg(T.ordered_concat(F.col("page"), F.col("text"), "\n").alias("content"), F.count(F.lit(1)).alias("end_page")).select(*book, F.lit("Full Document").alias("title"), F.lit(1).alias("number"), F.lit(1).alias("start_page"), F.col("end_page"), "content")


def large_images(images: DataFrame, least: int = 50) -> DataFrame:
    return images.filter((F.col("width") >= least) & (F.col("height") >= least))


def first_pages(images: DataFrame, book: str, xref: str, page: str, order: str) -> DataFrame:
    """Each image object once in its book, where it comes first."""
    return images.withColumn("_at", F.row_number().over(Window.partitionBy(book, xref).orderBy(page, order))).filter("_at = 1").drop("_at")


def image_lines(ranges: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, images, n_images) for ranges (keys, start_page, end_page) that any image falls into, by page and order.

    The first of keys is the book. Image pages that are null or 0 match nothing, nor do ranges without pages. A range
    becomes its pages, so this is an equi-join.
    """
    book = keys[:-1]
    seen = images.filter(F.coalesce(F.col("page_number"), F.lit(0)) != 0).select(*book, F.col("page_number").alias("_page"), "ord", T.image_context(F.col("image_type"), F.col("description"), F.col("ocr_text")).alias("_line"))
    inside = ranges.select(*keys, "start_page", "end_page").filter("start_page > 0 AND end_page > 0").withColumn("_page", F.explode(F.when(F.col("start_page") <= F.col("end_page"), F.sequence("start_page", "end_page"))))
    return inside.join(seen, [*book, "_page"]).groupBy(*keys).agg(T.ordered_concat(F.struct("_page", "ord"), F.col("_line"), "\n\n").alias("images"), F.count(F.lit(1)).alias("n_images"))


def with_images(rows: DataFrame, images: DataFrame, book: list[str], chapter: str = "number") -> DataFrame:
    """Chapters, or chunks of chapters, with what is seen on the images of the chapter's pages; the others stay as they are.

    All chunks of a chapter get all its images. Token counts aren't taken anew.
    """
    keys = [*book, chapter]
    lines = image_lines(rows.select(*keys, "start_page", "end_page").distinct(), images, keys)
    return rows.join(lines, keys, "left").withColumn("content", F.when(F.col("images").isNotNull(), F.concat("content", F.lit("\n\n[Image Context]\n"), "images")).otherwise(F.col("content"))).withColumn("n_images", F.coalesce("n_images", F.lit(0)))


def image_summary(images: DataFrame, book: list[str]) -> DataFrame:
    """(book, summary): what all images of a book show, a numbered line each in order."""
    line = F.concat(F.lit("Image "), (F.col("ord") + 1).cast("string"), F.lit(" ("), F.col("image_type"), F.lit("): "), F.col("description"))
    return images.withColumn("_line", line).groupBy(*book).agg(T.ordered_concat(F.col("ord"), F.col("_line"), "\n").alias("summary"))
