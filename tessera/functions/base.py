"""What the structures share: guards, the order type, and exceptions as raise_error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LESS, EQUAL, GREATER = "LESS", "EQUAL", "GREATER"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def raises(name: str, unless: Column, value: Column) -> Column:
    """value where unless holds, the exception otherwise: a guard inside the expression, so other rows are untouched."""
    return F.when(unless, value).otherwise(F.raise_error(F.lit(name)))


def order(a, b) -> Column:
    """LESS, EQUAL or GREATER; a missing value is the smallest and equals a missing value."""
    a, b = col(a), col(b)
    return F.when(a.eqNullSafe(b), EQUAL).when(a.isNull() | (a < b), LESS).otherwise(GREATER)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]
