"""EPUB files: chapters, images, contents and metadata, by zipfile and ElementTree."""

from __future__ import annotations

import base64
import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from . import markup

LEAST_CHARS, LEAST_SIDE = 100, 50
DC = "{http://purl.org/dc/elements/1.1/}"
OPF = "{http://www.idpf.org/2007/opf}"
BOOK = (
    "path string, status string, error string, title string, authors array<string>, publisher string, date string, language string, description string, subjects array<string>, "
    "identifiers array<struct<scheme: string, value: string>>, items array<struct<seq: int, title: string, content: string>>, "
    "images array<struct<ord: int, filename: string, content_type: string, width: int, height: int, base64_data: string>>, toc array<struct<seq: int, level: int, title: string, href: string, parent_seq: int>>"
)


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF or JPEG image, from its header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    raise ValueError("not an image that can be read")


def entries(tree: ElementTree.Element) -> list[dict]:
    """Entries of an NCX or a navigation document in reading order, with level and parent."""
    out: list[dict] = []

    def bare(e: ElementTree.Element) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def ncx(e: ElementTree.Element, level: int, parent: int | None) -> None:
        for point in (x for x in e if bare(x) == "navPoint"):
            label = next((x for x in point.iter() if bare(x) == "text"), None)
            source = next((x.get("src") for x in point if bare(x) == "content"), None)
            out.append({"seq": len(out), "level": level, "title": ("".join(label.itertext()) if label is not None else "").strip(), "href": source, "parent_seq": parent})
            ncx(point, level + 1, out[-1]["seq"])

    def nav(e: ElementTree.Element, level: int, parent: int | None) -> None:
        for item in (x for x in e if bare(x) == "li"):
            head = next((x for x in item if bare(x) in ("a", "span")), None)
            out.append({"seq": len(out), "level": level, "title": ("".join(head.itertext()) if head is not None else "").strip(), "href": head.get("href") if head is not None else None, "parent_seq": parent})
            own = out[-1]["seq"]
            for below in (x for x in item if bare(x) == "ol"):
                nav(below, level + 1, own)

    for e in tree.iter():
        if bare(e) == "navMap":
            ncx(e, 0, None)
            break
        if bare(e) == "nav":
            for below in (x for x in e if bare(x) == "ol"):
                nav(below, 0, None)
            if out:
                break
    return out


def parse(content: bytes) -> dict:
    """All that one file says, in manifest order; chapters aren't filtered or numbered yet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in root.iter() if isinstance(e.tag, str) and e.tag.endswith("rootfile"))
        opf, top = ElementTree.fromstring(z.read(package)), posixpath.dirname(package)
        many = lambda name: [(e.text or "").strip() for e in opf.iter(DC + name) if (e.text or "").strip()]
        first = lambda name: next(iter(many(name)), None)
        described = first("description")
        out: dict = {"title": first("title"), "authors": many("creator"), "publisher": first("publisher"), "date": first("date"), "language": first("language"), "subjects": many("subject"), "description": markup.text_of(described).strip() if described else None, "items": [], "images": [], "toc": []}
        out["identifiers"] = [{"scheme": e.get(OPF + "scheme") or e.get("scheme"), "value": (e.text or "").strip()} for e in opf.iter(DC + "identifier")]
        for seq, item in enumerate(opf.iter(OPF + "item")):
            kind, name = item.get("media-type", ""), posixpath.normpath(posixpath.join(top, unquote(item.get("href", ""))))
            if name not in z.namelist():
                continue
            if kind == "application/x-dtbncx+xml" or "nav" in (item.get("properties") or "").split():
                found = entries(ElementTree.fromstring(z.read(name)))
                out["toc"] = out["toc"] or found
            if kind in ("application/xhtml+xml", "text/html"):
                reader = markup.read(z.read(name).decode("utf-8", "ignore"))
                out["items"].append({"seq": seq, "title": reader.title, "content": "\n".join(reader.pieces)})
            elif kind.startswith("image/"):
                data = z.read(name)
                try:
                    width, height = image_size(data)
                except (ValueError, struct.error):
                    continue  # an image that can't be read is left out, the book stays
                out["images"].append({"ord": len(out["images"]), "filename": posixpath.basename(name), "content_type": kind, "width": width, "height": height, "base64_data": base64.b64encode(data).decode()})
        return out


def read(files: DataFrame) -> DataFrame:
    """One row of BOOK for each file (path, content); a file that can't be read has status failed and an error."""
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


def chapters(books: DataFrame) -> DataFrame:
    """(book_id, number, title, content, word_count): items of some length, numbered as they are kept."""
    items = books.select("book_id", F.explode("items").alias("i")).select("book_id", "i.seq", "i.title", T.strip(F.col("i.content")).alias("content"))
    kept = items.filter(F.length("content") >= LEAST_CHARS).withColumn("number", F.row_number().over(Window.partitionBy("book_id").orderBy("seq")))
    title = F.coalesce(T.clip(F.nullif(T.strip(F.col("title")), F.lit("")), 200), F.concat(F.lit("Chapter "), F.col("number").cast("string")))
    none = F.lit(None).cast("int")
    return kept.select("book_id", "number", title.alias("title"), none.alias("start_page"), none.alias("end_page"), "content", T.word_count(F.col("content")).alias("word_count"))


def metadata(books: DataFrame) -> DataFrame:
    isbn, isbn13 = T.isbn_columns(F.col("identifiers"))
    return books.select("book_id", F.coalesce("title", T.file_stem(F.col("path"))).alias("title"), "authors", "publisher", "date", "language", "description", "subjects", isbn.alias("isbn"), isbn13.alias("isbn13"))


def contents(books: DataFrame) -> DataFrame:
    """(book_id, seq, level, title, href, parent_seq) of the contents in reading order."""
    return books.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*")


def images(books: DataFrame) -> DataFrame:
    each = books.select("book_id", F.explode("images").alias("i")).select("book_id", "i.*").withColumn("page_number", F.lit(None).cast("int"))
    return each.filter((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE))
