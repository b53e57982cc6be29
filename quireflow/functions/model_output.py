"""Normal forms of what models answer: variants in, plain columns out, without Python workers but for strict JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Most entries that are kept of each list.
GENRES, TAGS, TOPICS, TAKEAWAYS, KEY_POINTS, PRIMARY_THEMES, SECONDARY_THEMES, QUOTES, CONCEPTS = 3, 10, 10, 7, 5, 5, 4, 15, 30


def salvaged(text: str | None) -> str | None:
    """The JSON document in an answer: all of it, or what starts at the first brace; None if neither is valid."""
    for start in (0, (text or "").find("{")):
        if text and start >= 0:
            try:
                json.loads(text[start:])
                return text[start:]
            except ValueError:
                pass
    return None


def strict_json(raw: Column) -> Column:
    """The valid JSON document in each answer, or null.

    Spark's own parser takes text after a document for nothing, so it can't tell a valid answer from a broken one.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(salvaged)

    return run(raw)


def parsed(clean: Column) -> Column:
    return F.try_parse_json(clean)


def text_at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def list_at(v: Column, name: str, most: int | None = None) -> Column:
    """A list of strings; a single string counts as a list of one, blank members go, the others are stripped."""
    many = F.try_variant_get(v, f"$.{name}", "array<string>")
    one = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.array(text_at(v, name)))
    found = F.coalesce(many, one, F.array().cast("array<string>"))
    clean = F.transform(F.filter(found, lambda x: x.isNotNull() & (x != "")), strip)
    return F.slice(clean, 1, most) if most else clean


def structs_at(v: Column, name: str, fields: str) -> Column:
    """A list of objects as structs of the given string fields; a member that is no object is null in all of them."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", f"array<struct<{fields}>>"), F.array().cast(f"array<struct<{fields}>>"))


def themes_at(v: Column, name: str, most: int) -> Column:
    """Themes as (name, description): objects with a default name, strings as names without a description."""
    members = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda x: F.schema_of_variant(x)
    held = F.filter(members, lambda x: x.isNotNull() & (F.startswith(kind(x), F.lit("OBJECT")) | (kind(x) == "STRING")))
    made = F.transform(
        held,
        lambda x: F.when(kind(x) == "STRING", F.struct(F.try_variant_get(x, "$", "string").alias("name"), F.lit("").alias("description"))).otherwise(
            F.struct(F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit("Unknown")).alias("name"), F.coalesce(F.try_variant_get(x, "$.description", "string"), F.lit("")).alias("description"))
        ),
    )
    return F.slice(made, 1, most)


def defaulted(value: Column, status: Column, broken: str) -> Column:
    """value; where the answer was no JSON the given default, and where the call itself failed an empty string."""
    return F.when(status == "exception", F.lit("")).when(status == "parse_error", F.lit(broken)).otherwise(F.coalesce(value, F.lit(broken)))


def ocr_text(raw: Column) -> Column:
    return F.when(F.upper(strip(raw)) == "NO_TEXT", F.lit("")).otherwise(strip(raw))


def image_class(raw: Column) -> Column:
    return F.coalesce(F.lower(strip(raw)), F.lit("unknown"))


def preferred(first: Column, second: Column) -> Column:
    """first unless it is null or empty, else second."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def preferred_list(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(F.coalesce(second, F.array().cast("array<string>")))


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")
