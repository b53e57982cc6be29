"""Vector functions in double precision, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine similarity in [-1, 1]; 0 if either vector is all zeros. A norm of b that is known needn't be taken for each row."""
    scale = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def query_vector(values: list[float]) -> Column:
    """A vector that is known on the driver, as a literal."""
    return F.array(*[F.lit(float(x)) for x in values])


def checked_dimension(v: Column, size: int) -> Column:
    """v, or an error where it has another dimension."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {size} dimensions, found "), F.size(v).cast("string")))
    return F.when(F.size(v) == size, v).otherwise(wrong)
