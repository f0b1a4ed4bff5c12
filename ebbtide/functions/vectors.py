"""Column functions over vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL when one is missing or all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_reason(a: Column, b: Column, version_a: Column | None = None, version_b: Column | None = None) -> Column:
    """Why no cosine can be given, NULL when it can."""
    reason = (
        F.when(a.isNull() | b.isNull(), F.lit("missing_vector"))
        .when(F.size(a) != F.size(b), F.lit("size_mismatch"))
        .when(is_zero(a) | is_zero(b), F.lit("zero_vector"))
    )
    if version_a is not None and version_b is not None:
        reason = reason.when(version_a != version_b, F.lit("version_mismatch"))
    return reason
