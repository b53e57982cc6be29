"""PDF files. Reading the format needs the optional fitz module; all that follows from page texts is DataFrame work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import chapters as C

BOOK = (
    "path string, status string, error string, page_count int, info map<string,string>, pages array<struct<page: int, text: string>>, toc array<struct<seq: int, level: int, title: string, page: int>>, "
    "images array<struct<ord: int, xref: int, ext: string, width: int, height: int, page_number: int, base64_data: string>>"
)


def parse(content: bytes) -> dict:
    import base64

    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        images = []
        for page in doc:
            for found in page.get_images(full=True):
                try:
                    image = doc.extract_image(found[0])
                except (ValueError, RuntimeError):
                    continue  # an image that can't be read is left out, the book stays
                images.append({"ord": len(images), "xref": found[0], "ext": image["ext"], "width": image["width"], "height": image["height"], "page_number": page.number + 1, "base64_data": base64.b64encode(image["image"]).decode()})
        toc = [{"seq": k, "level": level, "title": title, "page": page} for k, (level, title, page) in enumerate(doc.get_toc())]
        return {"page_count": len(doc), "info": doc.metadata, "pages": [{"page": p.number + 1, "text": p.get_text()} for p in doc], "toc": toc, "images": images}


def read(files: DataFrame) -> DataFrame:
    """One row of BOOK for each file (path, content); without the module every file fails with that error."""
    schema = to_arrow_schema(StructType.fromDDL(BOOK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    row = parse(content) | {"status": "completed", "error": None}
                except Exception as e:  # any broken file is a row with its error
                    row = {"status": "failed", "error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([{k: row.get(k) for k in schema.names} | {"path": path}], schema=schema)

    return files.select("path", "content").mapInArrow(run, BOOK)


def metadata(books: DataFrame) -> DataFrame:
    """Metadata with empty strings as null, names split, and the date as YYYY-MM-DD."""
    info = lambda k: F.nullif(F.try_element_at("info", F.lit(k)), F.lit(""))
    listed = lambda k: F.coalesce(T.split_names(info(k)), F.array().cast("array<string>"))
    return books.select("book_id", F.coalesce(info("title"), T.file_stem(F.col("path"))).alias("title"), listed("author").alias("authors"), listed("keywords").alias("subjects"), info("subject").alias("description"), T.pdf_date(info("creationDate")).alias("date"), info("producer").alias("producer"), info("creator").alias("creator"), "page_count")


def chapters(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters by the contents, or one with the whole book where there is none; pages count from 1, levels too."""
    last = pages.groupBy("book_id").agg(F.max("page").alias("n_pages"))
    ranges = C.page_ranges(toc, last, ["book_id"])
    by_toc = C.chapter_pages(ranges, pages, ["book_id"]).select("book_id", "number", "title", "start_page", "end_page", "content")
    whole = C.whole_books(pages, toc, ["book_id"]).select("book_id", "number", "title", "start_page", F.col("end_page").cast("int").alias("end_page"), "content")
    return by_toc.unionByName(whole).withColumn("word_count", T.word_count(F.col("content")))


def contents(books: DataFrame) -> DataFrame:
    """(book_id, seq, level, title, page) of the contents, levels from 0 as in EPUB files, pages from 1."""
    each = books.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*")
    return each.select("book_id", "seq", (F.col("level") - 1).alias("level"), "title", "page")


def images(books: DataFrame) -> DataFrame:
    """Each image object once, on its first page, if it is large enough, with a name made from page and object."""
    each = books.select("book_id", F.explode("images").alias("i")).select("book_id", "i.*")
    return C.large_images(C.first_pages(each, "book_id", "xref", "page_number", "ord")).withColumn("filename", T.image_name(F.col("page_number"), F.col("xref"), F.col("ext"))).withColumn("content_type", F.concat(F.lit("image/"), F.col("ext")))
