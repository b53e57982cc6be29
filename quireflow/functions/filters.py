"""Payload filters: a dictionary of fields to predicates, in which a missing value never matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def terms(df: DataFrame, filters: dict[str, object] | None) -> list[Column]:
    """A predicate for each field; null where the value is missing.

    A list asks for any of its values, a scalar for equality; on an array column for any element.
    """
    out = []
    for name, wanted in (filters or {}).items():
        column, many = F.col(name), isinstance(wanted, (list, tuple, set))
        if isinstance(df.schema[name].dataType, ArrayType):
            term = F.arrays_overlap(column, F.array(*[F.lit(x) for x in wanted])) if many else F.array_contains(column, wanted)
            out.append(F.lit(False) if many and not wanted else term)
        else:
            out.append(column.isin(*wanted) if many else column == F.lit(wanted))
    return out


def matching(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """The rows that match all fields. Terms on plain columns reach the scan as they are."""
    return reduce(lambda rows, term: rows.filter(term), terms(df, filters), df)


def predicate(df: DataFrame, filters: dict[str, object] | None) -> Column:
    """All fields as one predicate that is never null, so that it may be negated."""
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in terms(df, filters)], F.lit(True))
