"""Range: intervals of integers or other ordered values, and sets made of them.

A range is a plan-time value (lo, hi and whether each end belongs to it); membership becomes a comparison
of columns, and a finite integer range a DataFrame or a sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.base import col
from tessera.operators.errors import RelError


@dataclass(frozen=True)
class Range:
    lo: object = None  # None: no end on this side
    hi: object = None
    lo_in: bool = True
    hi_in: bool = True

    @staticmethod
    def point(x) -> Range:
        return Range(x, x)

    @staticmethod
    def closed(lo, hi) -> Range:
        return Range(lo, hi)

    @staticmethod
    def open(lo, hi) -> Range:
        return Range(lo, hi, False, False)

    @staticmethod
    def closed_open(lo, hi) -> Range:
        return Range(lo, hi, True, False)

    @staticmethod
    def open_closed(lo, hi) -> Range:
        return Range(lo, hi, False, True)

    @staticmethod
    def at_least(lo) -> Range:
        return Range(lo)

    @staticmethod
    def greater_than(lo) -> Range:
        return Range(lo, None, False)

    @staticmethod
    def at_most(hi) -> Range:
        return Range(None, hi)

    @staticmethod
    def less_than(hi) -> Range:
        return Range(None, hi, True, False)

    def contains(self, x) -> Column:
        x, test = col(x), F.lit(True)
        if self.lo is not None:
            test = test & (x >= col(self.lo) if self.lo_in else x > col(self.lo))
        if self.hi is not None:
            test = test & (x <= col(self.hi) if self.hi_in else x < col(self.hi))
        return test

    def integers(self) -> tuple[int, int]:
        """The first and the last integer."""
        if self.lo is None or self.hi is None:
            raise RelError("Domain")
        return self.lo + (not self.lo_in), self.hi - (not self.hi_in)

    @property
    def is_empty(self) -> bool:
        return self.lo is not None and self.hi is not None and (self.lo > self.hi or (self.lo == self.hi and not (self.lo_in and self.hi_in)))


def _start(r: Range):
    return (r.lo is not None, r.lo if r.lo is not None else 0, not r.lo_in)


def _end(r: Range):
    return (r.hi is None, r.hi if r.hi is not None else 0, r.hi_in)


def _touch(a: Range, b: Range, discrete: bool) -> bool:
    """Whether b, which starts no earlier, overlaps a or joins its end."""
    if a.hi is None or b.lo is None:
        return True
    if discrete:
        return (b.lo + (not b.lo_in)) <= (a.hi - (not a.hi_in)) + 1
    return b.lo < a.hi or (b.lo == a.hi and (b.lo_in or a.hi_in))


def normalised(ranges: list[Range], discrete: bool) -> list[Range]:
    out: list[Range] = []
    for r in sorted((r for r in ranges if not r.is_empty), key=_start):
        if out and _touch(out[-1], r, discrete):
            if _end(r) > _end(out[-1]):
                out[-1] = Range(out[-1].lo, r.hi, out[-1].lo_in, r.hi_in)
        else:
            out.append(r)
    return out


@dataclass(frozen=True)
class RangeSet:
    """Disjoint ranges in order."""

    ranges: tuple[Range, ...]
    discrete: bool

    @staticmethod
    def continuous(ranges: list[Range]) -> RangeSet:
        return RangeSet(tuple(normalised(ranges, False)), False)

    @staticmethod
    def discrete_of(ranges: list[Range]) -> RangeSet:
        return RangeSet(tuple(normalised(ranges, True)), True)

    def contains(self, x) -> Column:
        test = F.lit(False)
        for r in self.ranges:
            test = test | r.contains(x)
        return test

    def complement(self) -> RangeSet:
        out, lo, lo_in, open_start = [], None, True, True
        for r in self.ranges:
            if not (open_start and r.lo is None):
                out.append(Range(lo, r.lo, lo_in, not r.lo_in))
            open_start = False
            if r.hi is None:
                return RangeSet.continuous(out)
            lo, lo_in = r.hi, not r.hi_in
        return RangeSet.continuous([*out, Range(lo, None, lo_in)])

    def to_list(self, spark: SparkSession, name: str = "value") -> DataFrame:
        """The integers, each range a generated scan."""
        df = spark.range(0).select(F.col("id").alias(name))
        for r in self.ranges:
            lo, hi = r.integers()
            df = df.unionByName(spark.range(lo, hi + 1).select(F.col("id").alias(name)))
        return df

    to_bag = to_list


def flatten(ranges: list[Range]) -> Column:
    """The integers of all ranges as an array, repeats included."""
    parts = []
    for r in ranges:
        lo, hi = r.integers()
        parts.append(F.sequence(F.lit(lo), F.lit(hi)) if lo <= hi else F.array().cast("array<int>"))
    return F.concat(*parts) if parts else F.array().cast("array<int>")
