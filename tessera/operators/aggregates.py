"""Aggregates for ``group`` and ``compute``: typed zeros, Empty on empty input, any user function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(_: Column | None = None) -> Column:
    """Rows, whatever they hold: ``count over ()`` counts units too."""
    return F.count(F.lit(1))


def sum_(x: Column, zero=0) -> Column:
    """The sum; of an empty group zero. Integers widen and never wrap."""
    return F.coalesce(F.sum(x), F.lit(zero))


def non_empty_or_raise(aggregate: Column) -> Column:
    """An aggregate that raises Empty for no rows at all. Missing values are values."""
    return F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("Empty"))).otherwise(aggregate)


def min_(x: Column) -> Column:
    """A missing value is the smallest."""
    return non_empty_or_raise(F.when(F.count(x) == F.count(F.lit(1)), F.min(x)))


def max_(x: Column) -> Column:
    return non_empty_or_raise(F.max(x))


def empty() -> Column:
    return F.count(F.lit(1)) == 0


def non_empty() -> Column:
    return F.count(F.lit(1)) > 0


def only(x: Column) -> Column:
    """The value of a group of one row; Empty or Size otherwise."""
    n = F.count(F.lit(1))
    return F.when(n == 0, F.raise_error(F.lit("Empty"))).when(n > 1, F.raise_error(F.lit("Size"))).otherwise(F.first(x))


def over(f: Callable[[Column], Column], x: Column, sort: bool = False) -> Column:
    """Any function of an array over the group's values: ``f over x``."""
    values = F.collect_list(x)
    return f(F.sort_array(values) if sort else values)


def average(x: Column) -> Column:
    """sum over count; an extension."""
    return F.avg(x)


def count_distinct(*xs: Column) -> Column:
    return F.count_distinct(*xs)
