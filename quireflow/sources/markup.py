"""Markup of books and pages to text and headings, by the standard library's parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT = frozenset(["script", "style", "template"])
TITLES = ("h1", "h2", "h3", "title")


class Reader(HTMLParser):
    """Collects the text pieces and the first heading of a document, and the images it names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.silent = 0
        self.title: str | None = None
        self.open_title: str | None = None
        self.held: list[str] = []
        self.images: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in TITLES and self.title is None and self.open_title is None:
            self.open_title, self.held = tag, []
        elif tag in ("img", "image"):
            named = dict(attrs)
            if source := named.get("src") or named.get("xlink:href") or named.get("href"):
                self.images.append(source)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == self.open_title:
            self.title, self.open_title = "".join(self.held).strip(), None

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.open_title:
            self.held.append(data)
        if piece := data.strip():
            self.pieces.append(piece)


def read(markup: str) -> Reader:
    reader = Reader()
    reader.feed(markup)
    reader.close()
    if reader.open_title and reader.title is None:
        reader.title = "".join(reader.held).strip()
    return reader


def text_of(markup: str | None) -> str:
    return "\n".join(read(markup or "").pieces)


def mapped(markup: Column, read_one: Callable[[str | None], str | None]) -> Column:
    """A function of one document over a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(read_one)

    return run(markup)


def html_to_text(markup: Column) -> Column:
    """The stripped text pieces of a document, a line each; scripts, styles and comments are left out."""
    return mapped(markup, text_of)


def html_parts(markup: Column) -> Column:
    """struct (title, text) of a document, as html_title and html_to_text give them, from one reading of it."""

    @F.pandas_udf("title string, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            readers = [read(x or "") for x in batch]
            yield pd.DataFrame({"title": [r.title or None for r in readers], "text": ["\n".join(r.pieces) for r in readers]}, dtype=object)

    return run(markup)


def html_title(markup: Column) -> Column:
    """The first of h1, h2, h3 and title in document order, or null."""
    return mapped(markup, lambda x: read(x or "").title or None)


def marked_title(markup: Column) -> Column:
    """What stands between the first opening h1, h2, h3 or title and the next closing tag, as it is written, or null.

    Without a parser: of all references only &lt;, &gt; and &amp; are decoded, in this order, and tags inside stay.
    """
    found = F.regexp_extract(markup, r"(?is)<(?:h1|h2|h3|title)[^>]*>(.*?)</", 1)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        found = F.replace(found, F.lit(name), F.lit(sign))
    return F.nullif(F.btrim(found, F.lit(" \t\n\f\r")), F.lit(""))
