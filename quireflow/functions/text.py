"""Text functions as column expressions; all count code points, as Spark and the checks' SQL both do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, and the four separators that text functions elsewhere count as such.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space at both ends; plain trim() drops spaces only."""
    return F.btrim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    """Whether a text has nothing but white space."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def tokens_to_chars(tokens: Column) -> Column:
    return tokens * 4


def clip(text: Column, n: int, marker: str = "...") -> Column:
    """The text if it has at most n characters, else its first n and the marker."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit(marker)))


def preview(text: Column, n: int) -> Column:
    """The first n characters, always with three dots."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def split_names(text: Column) -> Column:
    """Names on commas if there are any, else on semicolons, else the one name; each stripped."""
    sep = F.when(F.contains(text, F.lit(",")), F.lit(",")).otherwise(F.lit(";"))
    return F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, sep)), strip)


def pdf_date(text: Column) -> Column:
    """D:YYYY[MM[DD]] as YYYY-MM-DD, with 01 for what is missing; null for anything else."""
    part = lambda k: F.regexp_extract(text, r"^D:(\d{4})(\d{2})?(\d{2})?", k)
    fill = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("01"))
    return F.when(part(1) != "", F.concat_ws("-", part(1), fill(part(2)), fill(part(3))))


def isbn_digits(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^0-9X]", "")


def isbn_columns(identifiers: Column) -> tuple[Column, Column]:
    """(isbn, isbn13) of an array of structs (scheme, value): the last of 10 and of 13 signs among those that name ISBN."""
    named = F.filter(identifiers, lambda x: (F.lower(F.coalesce(x.scheme, F.lit(""))) == "isbn") | F.contains(F.lower(x.value), F.lit("isbn")))
    signs = F.transform(named, lambda x: isbn_digits(x.value))
    last = lambda n: F.try_element_at(F.filter(signs, lambda s: F.length(s) == n), F.lit(-1))
    return last(10), last(13)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def image_name(page: Column, xref: Column, ext: Column) -> Column:
    return F.format_string("page%d_img%d.%s", page, xref, ext)


def toc_lines(entries: Column, indent: bool = False) -> Column:
    """Lines of an array of structs (level, title): a dash and the title, indented two spaces a level if asked for."""
    title = lambda e: F.coalesce(e.title, F.lit("Unknown"))
    line = lambda e: F.concat(F.repeat(F.lit("  "), e.level if indent else F.lit(0)), F.lit("- "), title(e))
    return F.array_join(F.transform(entries, line), "\n")


def chapter_line(title: Column, count: Column) -> Column:
    return F.format_string("- %s (%d words)", title, count)


def chapter_sample(chapters: Column, n: int, limit: int) -> Column:
    """The first n chapters (title, content), each cut at `limit` characters under its heading, between rule lines."""
    one = lambda c: F.concat(F.lit("## "), c.title, F.lit("\n\n"), clip(c.content, limit))
    return F.array_join(F.transform(F.slice(chapters, 1, n), one), "\n\n---\n\n")


def image_context(kind: Column, description: Column, ocr: Column, limit: int = 500) -> Column:
    """`[KIND] description` and, if the image has text, its first characters on a line of their own."""
    seen = F.concat(F.lit("["), F.upper(kind), F.lit("] "), F.coalesce(description, F.lit("")))
    return F.when(F.coalesce(ocr, F.lit("")) != "", F.concat(seen, F.lit("\nText: "), F.substring(ocr, 1, limit))).otherwise(seen)


def parts(text: Column, most: int = 3500, size: int = 3000) -> Column:
    """The text as one part if it has at most `most` characters, else cut every `size`."""
    places = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.transform(places, lambda i: F.substring(text, i * size + 1, F.lit(size))))


def ordered_concat(order: Column, text: Column, sep: str) -> Column:
    """Aggregate: the texts of a group in the given order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), text.alias("v")))), lambda x: x.v), sep)


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM dd, yyyy")


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_day(ts: Column) -> Column:
    return F.date_format(ts, "MMMM dd")


def without_mention(text: Column) -> Column:
    """A chat message without the mentions of users in it."""
    return strip(F.regexp_replace(text, r"<@[A-Za-z0-9]+>", ""))


def citation(title: Column, chapter: Column, page: Column, number: Column) -> Column:
    where = F.when(page.isNotNull(), F.concat(F.lit(", page "), page.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.format_string("[%d] ", number), title, F.lit(", "), chapter, where)


def content_id(content: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the content."""
    return F.substring(F.sha2(content, 256), 1, length)


def base64_text(content: Column) -> Column:
    """Base64 in one line; Spark's own breaks it every 76 signs."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def metadata_lines(values: dict[str, Column], nothing: str = "No metadata available") -> Column:
    """`name: value` lines of what is neither null nor empty, or a fixed sentence if all are."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v)) for name, v in values.items()]
    return F.coalesce(F.nullif(F.concat_ws("\n", *lines), F.lit("")), F.lit(nothing))
