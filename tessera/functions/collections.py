"""List, Bag, Vector, ListPair, Option and Either over array columns; an option is a nullable value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.base import EQUAL, GREATER, LESS, col, raises


def first_or_null(a: Column) -> Column:
    return F.get(a, F.lit(0))


def occurrence(a: Column) -> Column:
    """Each element with how many equal ones stand before it: array of struct<x, n>."""
    return F.transform(a, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y.eqNullSafe(x))).alias("n")))


def times(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y.eqNullSafe(x)))


class List:
    """Members of List; Bag has the same under its own names."""

    @staticmethod
    def nil(kind: str = "int") -> Column:
        return F.array().cast(f"array<{kind}>")

    @staticmethod
    def null(a) -> Column:
        return F.size(a) == 0

    @staticmethod
    def length(a) -> Column:
        return F.size(a)

    @staticmethod
    def at(a, b) -> Column:
        """a @ b"""
        return F.concat(a, b)

    @staticmethod
    def hd(a) -> Column:
        return raises("Empty", F.size(a) > 0, F.get(a, F.lit(0)))

    @staticmethod
    def tl(a) -> Column:
        return raises("Empty", F.size(a) > 0, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))

    @staticmethod
    def last(a) -> Column:
        return raises("Empty", F.size(a) > 0, F.get(a, F.size(a) - 1))

    @staticmethod
    def get_item(a) -> Column:
        """(head, tail), or missing for an empty list."""
        return F.when(F.size(a) > 0, F.struct(F.get(a, F.lit(0)).alias("_1"), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))).alias("_2")))

    @staticmethod
    def nth(a, i) -> Column:
        i = col(i)
        return raises("Subscript", (i >= 0) & (i < F.size(a)), F.get(a, i))

    @staticmethod
    def only(a) -> Column:
        return F.when(F.size(a) == 0, F.raise_error(F.lit("Empty"))).when(F.size(a) > 1, F.raise_error(F.lit("Size"))).otherwise(F.get(a, F.lit(0)))

    @staticmethod
    def take(a, i) -> Column:
        i = col(i)
        return raises("Subscript", (i >= 0) & (i <= F.size(a)), F.slice(a, F.lit(1), F.greatest(i, F.lit(0))))

    @staticmethod
    def drop(a, i) -> Column:
        i = col(i)
        return raises("Subscript", (i >= 0) & (i <= F.size(a)), F.slice(a, F.greatest(i, F.lit(0)) + 1, F.greatest(F.size(a) - i, F.lit(0))))

    @staticmethod
    def rev(a) -> Column:
        return F.reverse(a)

    @staticmethod
    def concat(a) -> Column:
        return F.flatten(a)

    @staticmethod
    def rev_append(a, b) -> Column:
        return F.concat(F.reverse(a), b)

    @staticmethod
    def map(f, a) -> Column:
        return F.transform(a, lambda x: f(x))

    @staticmethod
    def mapi(f, a) -> Column:
        return F.transform(a, lambda x, i: f(i, x))

    @staticmethod
    def map_partial(f, a) -> Column:
        return F.filter(F.transform(a, lambda x: f(x)), lambda x: x.isNotNull())

    @staticmethod
    def find(f, a) -> Column:
        return first_or_null(F.filter(a, lambda x: f(x)))

    @staticmethod
    def filter(f, a) -> Column:
        return F.filter(a, lambda x: f(x))

    @staticmethod
    def partition(f, a) -> Column:
        return F.struct(F.filter(a, lambda x: f(x)).alias("_1"), F.filter(a, lambda x: ~f(x)).alias("_2"))

    @staticmethod
    def foldl(f, init, a) -> Column:
        """f(element, accumulator); the accumulator has init's type throughout."""
        return F.aggregate(a, col(init), lambda acc, x: f(x, acc))

    @staticmethod
    def foldr(f, init, a) -> Column:
        return F.aggregate(F.reverse(a), col(init), lambda acc, x: f(x, acc))

    fold = foldl

    @staticmethod
    def exists(f, a) -> Column:
        return F.exists(a, lambda x: f(x))

    @staticmethod
    def all(f, a) -> Column:
        return F.forall(a, lambda x: f(x))

    @staticmethod
    def tabulate(n, f) -> Column:
        n = col(n)
        places = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
        return raises("Size", n >= 0, F.transform(places, lambda i: f(i)))

    @staticmethod
    def collate(compare, a, b) -> Column:
        n = F.least(F.size(a), F.size(b))
        first = first_or_null(F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: compare(x, y)), lambda o: o != EQUAL))
        return F.coalesce(first, F.when(F.size(a) < F.size(b), LESS).when(F.size(a) > F.size(b), GREATER).otherwise(EQUAL))

    @staticmethod
    def except_(first, *rest) -> Column:
        """Multiset difference: the earliest elements go."""
        gone = F.concat(*rest) if len(rest) > 1 else rest[0]
        return F.transform(F.filter(occurrence(first), lambda p: p["n"] >= times(gone, p["x"])), lambda p: p["x"])

    @staticmethod
    def intersect(first, *rest) -> Column:
        """Multiset meet: the smallest number of times in any list."""

        def kept(p: Column) -> Column:
            test = p["n"] < times(rest[0], p["x"])
            for r in rest[1:]:
                test = test & (p["n"] < times(r, p["x"]))
            return test

        return F.transform(F.filter(occurrence(first), kept), lambda p: p["x"])

    @staticmethod
    def elem(x, a) -> Column:
        return F.exists(a, lambda y: y.eqNullSafe(col(x)))

    @staticmethod
    def notelem(x, a) -> Column:
        return ~List.elem(x, a)

    @staticmethod
    def app(f, values) -> None:
        """Effects happen on the driver, over collected values."""
        for v in values:
            f(v)


class Bag(List):
    """An array whose order means nothing."""

    @staticmethod
    def from_list(a) -> Column:
        return a

    @staticmethod
    def to_list(a) -> Column:
        return a


class Vector(List):
    max_len = 2**24 - 1

    @staticmethod
    def from_list(a) -> Column:
        return a

    sub = List.nth

    @staticmethod
    def update(a, i, x) -> Column:
        i = col(i)
        return raises("Subscript", (i >= 0) & (i < F.size(a)), F.transform(a, lambda y, j: F.when(j == i, col(x)).otherwise(y)))

    @staticmethod
    def indexed(a) -> Column:
        return F.transform(a, lambda x, i: F.struct(i.alias("_1"), x.alias("_2")))

    @staticmethod
    def foldli(f, init, a) -> Column:
        return F.aggregate(Vector.indexed(a), col(init), lambda acc, p: f(p["_1"], p["_2"], acc))

    @staticmethod
    def foldri(f, init, a) -> Column:
        return F.aggregate(F.reverse(Vector.indexed(a)), col(init), lambda acc, p: f(p["_1"], p["_2"], acc))

    @staticmethod
    def findi(f, a) -> Column:
        return first_or_null(F.filter(Vector.indexed(a), lambda p: f(p["_1"], p["_2"])))

    @staticmethod
    def appi(f, values) -> None:
        for i, v in enumerate(values):
            f(i, v)


class ListPair:
    """Two lists, cut to the shorter; the Eq members raise UnequalLengths instead."""

    @staticmethod
    def zip(a, b) -> Column:
        n = F.least(F.size(a), F.size(b))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))

    @staticmethod
    def same(a, b, value: Column) -> Column:
        return raises("UnequalLengths", F.size(a) == F.size(b), value)

    @staticmethod
    def zip_eq(a, b) -> Column:
        return ListPair.same(a, b, ListPair.zip(a, b))

    @staticmethod
    def unzip(a) -> Column:
        return F.struct(F.transform(a, lambda p: p["_1"]).alias("_1"), F.transform(a, lambda p: p["_2"]).alias("_2"))

    @staticmethod
    def map(f, a, b) -> Column:
        return F.transform(ListPair.zip(a, b), lambda p: f(p["_1"], p["_2"]))

    @staticmethod
    def map_eq(f, a, b) -> Column:
        return ListPair.same(a, b, ListPair.map(f, a, b))

    @staticmethod
    def all(f, a, b) -> Column:
        return F.forall(ListPair.zip(a, b), lambda p: f(p["_1"], p["_2"]))

    @staticmethod
    def all_eq(f, a, b) -> Column:
        return (F.size(a) == F.size(b)) & ListPair.all(f, a, b)

    @staticmethod
    def exists(f, a, b) -> Column:
        return F.exists(ListPair.zip(a, b), lambda p: f(p["_1"], p["_2"]))

    @staticmethod
    def foldl(f, init, a, b) -> Column:
        return F.aggregate(ListPair.zip(a, b), col(init), lambda acc, p: f(p["_1"], p["_2"], acc))

    @staticmethod
    def foldr(f, init, a, b) -> Column:
        return F.aggregate(F.reverse(ListPair.zip(a, b)), col(init), lambda acc, p: f(p["_1"], p["_2"], acc))

    @staticmethod
    def foldl_eq(f, init, a, b) -> Column:
        return ListPair.same(a, b, ListPair.foldl(f, init, a, b))

    @staticmethod
    def foldr_eq(f, init, a, b) -> Column:
        return ListPair.same(a, b, ListPair.foldr(f, init, a, b))

    @staticmethod
    def app(f, a, b) -> None:
        for x, y in zip(a, b, strict=False):
            f(x, y)

    @staticmethod
    def app_eq(f, a, b) -> None:
        if len(a) != len(b):
            raise ValueError("UnequalLengths")
        ListPair.app(f, a, b)


class Option:
    """NONE is null. An option of an option needs a struct: nested() makes one, join() undoes it."""

    @staticmethod
    def get_opt(x, default) -> Column:
        return F.coalesce(x, col(default))

    @staticmethod
    def is_some(x) -> Column:
        return x.isNotNull()

    @staticmethod
    def val_of(x) -> Column:
        return raises("Option", x.isNotNull(), x)

    @staticmethod
    def filter(p, x) -> Column:
        return F.when(p(col(x)), col(x))

    @staticmethod
    def nested(x) -> Column:
        return F.struct(x.alias("some"))

    @staticmethod
    def join(x) -> Column:
        return x.getField("some")

    @staticmethod
    def map(f, x) -> Column:
        return F.when(x.isNotNull(), f(x))

    map_partial = map

    @staticmethod
    def compose(f, g):
        return lambda x: Option.map(f, g(x))

    compose_partial = compose

    @staticmethod
    def app(f, x) -> None:
        if x is not None:
            f(x)


class Either:
    """struct<tag, l, r>: tag 0 is INL, 1 is INR."""

    @staticmethod
    def inl(x, right: str = "int") -> Column:
        return F.struct(F.lit(0).alias("tag"), col(x).alias("l"), F.lit(None).cast(right).alias("r"))

    @staticmethod
    def inr(x, left: str = "int") -> Column:
        return F.struct(F.lit(1).alias("tag"), F.lit(None).cast(left).alias("l"), col(x).alias("r"))

    @staticmethod
    def is_left(e) -> Column:
        return e["tag"] == 0

    @staticmethod
    def is_right(e) -> Column:
        return e["tag"] == 1

    @staticmethod
    def as_left(e) -> Column:
        return F.when(e["tag"] == 0, e["l"])

    @staticmethod
    def as_right(e) -> Column:
        return F.when(e["tag"] == 1, e["r"])

    @staticmethod
    def map(f, g, e) -> Column:
        return F.struct(e["tag"].alias("tag"), F.when(e["tag"] == 0, f(e["l"])).alias("l"), F.when(e["tag"] == 1, g(e["r"])).alias("r"))

    @staticmethod
    def map_left(f, e) -> Column:
        return Either.map(f, lambda x: x, e)

    @staticmethod
    def map_right(g, e) -> Column:
        return Either.map(lambda x: x, g, e)

    @staticmethod
    def fold(f, g, init, e) -> Column:
        return F.when(e["tag"] == 0, f(e["l"], col(init))).otherwise(g(e["r"], col(init)))

    @staticmethod
    def proj(e) -> Column:
        return F.when(e["tag"] == 0, e["l"]).otherwise(e["r"])

    @staticmethod
    def partition(a) -> Column:
        side = lambda tag, field: F.transform(F.filter(a, lambda e: e["tag"] == tag), lambda e: e[field])
        return F.struct(side(0, "l").alias("_1"), side(1, "r").alias("_2"))

    @staticmethod
    def app(f, g, tag: int, value) -> None:
        (f if tag == 0 else g)(value)

    @staticmethod
    def app_left(f, tag: int, value) -> None:
        if tag == 0:
            f(value)

    @staticmethod
    def app_right(g, tag: int, value) -> None:
        if tag == 1:
            g(value)
