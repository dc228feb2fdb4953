"""Fn, General and Relational: combinators that are applied while a plan is made, and comparison."""

from __future__ import annotations

from pyspark.sql import Column

from tessera.functions.base import col, order


class Fn:
    @staticmethod
    def id(x):
        return x

    @staticmethod
    def const(x):
        return lambda _: x

    @staticmethod
    def apply(f, x):
        return f(x)

    @staticmethod
    def o(f, g):
        return lambda x: f(g(x))

    @staticmethod
    def curry(f):
        return lambda x: lambda y: f((x, y))

    @staticmethod
    def uncurry(f):
        return lambda p: f(p[0])(p[1])

    @staticmethod
    def flip(f):
        return lambda p: f((p[1], p[0]))

    @staticmethod
    def repeat(n: int, f):
        if n < 0:
            raise ValueError("Domain")

        def repeated(x):
            for _ in range(n):
                x = f(x)
            return x

        return repeated

    @staticmethod
    def equal(a, b) -> Column:
        return col(a).eqNullSafe(col(b))

    @staticmethod
    def not_equal(a, b) -> Column:
        return ~col(a).eqNullSafe(col(b))


class General:
    o = Fn.o

    @staticmethod
    def exn_name(e: Exception) -> str:
        """The exception's name, whether Python or a plan raised it."""
        text = str(e)
        return text.split("] ")[1].split()[0].rstrip(".") if "USER_RAISED_EXCEPTION" in text else text.split()[0] if text else type(e).__name__

    @staticmethod
    def exn_message(e: Exception) -> str:
        return str(e)

    @staticmethod
    def before(x, _):
        return x

    @staticmethod
    def ignore(_) -> None:
        return None


class Relational:
    """compare; the aggregates are in ``operators.aggregates`` and iterate in ``operators.fixpoint``."""

    @staticmethod
    def compare(a, b) -> Column:
        return order(a, b)
