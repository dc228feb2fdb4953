"""Unbounded variables: queries whose predicates are turned into finite generators.

``solve({"x": int, "y": int}, p)`` gives every assignment for which p holds, once. Conjuncts that can
generate their variables become DataFrames joined in dependency order: membership in a collection,
equality with a bound expression, prefixes of a string, alternatives, quantified inner queries, recursive
predicates (by semi-naive rounds), and integer intervals, which are first narrowed by propagating all
comparisons. What is left is a filter. A variable that nothing generates is an error.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.errors import RelError
from tessera.operators.fixpoint import iterate

ROUNDS = 8
#: Largest constant interval that is enumerated for a variable.
LARGEST = 1 << 40
_fresh = itertools.count()


class NotGrounded(RelError):
    def __init__(self, name: str):
        super().__init__(f"pattern '{name}' is not grounded")


class Term:
    def __add__(self, o):
        return Arith("+", self, term(o))

    def __radd__(self, o):
        return Arith("+", term(o), self)

    def __sub__(self, o):
        return Arith("-", self, term(o))

    def __rsub__(self, o):
        return Arith("-", term(o), self)

    def __mul__(self, o):
        return Arith("*", self, term(o))

    __rmul__ = __mul__

    def __lt__(self, o):
        return Cmp("<", self, term(o))

    def __le__(self, o):
        return Cmp("<=", self, term(o))

    def __gt__(self, o):
        return Cmp("<", term(o), self)

    def __ge__(self, o):
        return Cmp("<=", term(o), self)

    def __eq__(self, o):
        return Cmp("=", self, term(o))

    def __ne__(self, o):
        return Cmp("<>", self, term(o))

    __hash__ = object.__hash__


class Sym(Term):
    def __init__(self, name: str):
        self.name = name


class Lit(Term):
    def __init__(self, value):
        self.value = value


class Arith(Term):
    def __init__(self, op: str, *args):
        self.op, self.args = op, args


def term(x) -> Term:
    return x if isinstance(x, Term) else Lit(x)


def abs_(x) -> Term:
    return Arith("abs", term(x))


def mod(x, k: int) -> Term:
    """The remainder with the divisor's sign."""
    return Arith("mod", term(x), Lit(k))


class Pred:
    def __and__(self, o):
        return And((self, o))

    def __or__(self, o):
        return Or((self, o))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True, eq=False)
class Cmp(Pred):
    op: str
    a: Term
    b: Term

    def __bool__(self):
        raise RelError("a comparison of unbounded variables has no truth value here; use & | ~")


@dataclass(frozen=True, eq=False)
class And(Pred):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Or(Pred):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Not(Pred):
    part: Pred


@dataclass(frozen=True, eq=False)
class Elem(Pred):
    """(terms) elem a collection, column by column."""

    terms: tuple
    rows: DataFrame


@dataclass(frozen=True, eq=False)
class Prefix(Pred):
    """part is a prefix of whole"""

    part: Term
    whole: Term


@dataclass(frozen=True, eq=False)
class Exists(Pred):
    names: tuple
    inner: Pred


@dataclass(frozen=True, eq=False)
class Call(Pred):
    rule: Recursive
    terms: tuple


def elem(terms, rows: DataFrame) -> Pred:
    return Elem(tuple(term(t) for t in (terms if isinstance(terms, tuple) else (terms,))), rows)


def prefix(part, whole) -> Pred:
    return Prefix(term(part), term(whole))


def exists(f: Callable) -> Pred:
    """exists(lambda z: p): z is a new variable."""
    names = tuple(f"_{n}{next(_fresh)}" for n in f.__code__.co_varnames[: f.__code__.co_argcount])
    return Exists(names, f(*map(Sym, names)))


def between(x, lo, hi) -> Pred:
    return And((term(lo) <= term(x), term(x) <= term(hi)))


class Recursive:
    """A predicate defined by itself: ``path = Recursive(lambda path, x, y: elem((x, y), edges) | ...)``."""

    def __init__(self, f: Callable):
        self.f = f
        self.params = f.__code__.co_varnames[1 : f.__code__.co_argcount]
        self._rows: DataFrame | None = None

    def __call__(self, *terms) -> Pred:
        return Call(self, tuple(term(t) for t in terms))

    def rows(self) -> DataFrame:
        """All tuples that satisfy it: the branches without a call begin, the others step."""
        if self._rows is None:
            body = self.f(self, *map(Sym, self.params))
            branches = list(body.parts) if isinstance(body, Or) else [body]
            branches = [x for b in branches for x in flattened(b, Or)]
            base = [b for b in branches if not calls(b, self)]
            steps = [b for b in branches if calls(b, self)]
            if not base:
                raise RelError("a recursive predicate needs a branch without itself")
            names = list(self.params)
            seed = union([solve(names, b, False) for b in base])
            if not steps:
                self._rows = seed
            else:

                def step(total: DataFrame, new: DataFrame) -> DataFrame:
                    made = []
                    for b in steps:
                        for at in range(calls(b, self)):  # each call in turn reads the new rows, the others all
                            made.append(solve(names, unfolded(b, self, total, new, at, itertools.count()), False))
                    return union(made)

                self._rows = iterate(seed, step, distinct_seed=True)
        return self._rows


def union(frames: list[DataFrame]) -> DataFrame:
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return df.distinct()


def calls(p: Pred, rule: Recursive) -> int:
    if isinstance(p, Call):
        return int(p.rule is rule)
    return sum(calls(x, rule) for x in children(p))


def children(p: Pred) -> tuple:
    return p.parts if isinstance(p, And | Or) else (p.part,) if isinstance(p, Not) else (p.inner,) if isinstance(p, Exists) else ()


def unfolded(p: Pred, rule: Recursive, total: DataFrame, new: DataFrame, at: int, seen) -> Pred:
    if isinstance(p, Call) and p.rule is rule:
        return Elem(p.terms, new if next(seen) == at else total)
    again = lambda x: unfolded(x, rule, total, new, at, seen)
    if isinstance(p, And | Or):
        return type(p)(tuple(again(x) for x in p.parts))
    if isinstance(p, Not):
        return Not(again(p.part))
    if isinstance(p, Exists):
        return Exists(p.names, again(p.inner))
    return p


def flattened(p: Pred, kind: type) -> list[Pred]:
    return [y for x in p.parts for y in flattened(x, kind)] if isinstance(p, kind) else [p]


def names_in(x) -> set[str]:
    if isinstance(x, Sym):
        return {x.name}
    if isinstance(x, Arith):
        return set().union(*map(names_in, x.args))
    if isinstance(x, Cmp):
        return names_in(x.a) | names_in(x.b)
    if isinstance(x, Elem | Call):
        return set().union(*map(names_in, x.terms))
    if isinstance(x, Prefix):
        return names_in(x.part) | names_in(x.whole)
    if isinstance(x, Exists):
        return names_in(x.inner) - set(x.names)
    if isinstance(x, Pred):
        return set().union(*map(names_in, children(x)))
    return set()


def as_column(t: Term) -> Column:
    if isinstance(t, Sym):
        return F.col(t.name)
    if isinstance(t, Lit):
        return F.lit(t.value)
    args = [as_column(a) for a in t.args]
    if t.op == "abs":
        return F.abs(args[0])
    if t.op == "mod":
        from tessera.functions.numbers import Int

        return Int.mod(*args)
    return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}[t.op](*args)


def filtered(df: DataFrame, p: Pred) -> DataFrame:
    """df's rows for which p holds; all its variables are columns."""
    if isinstance(p, And):
        for x in p.parts:
            df = filtered(df, x)
        return df
    if isinstance(p, Cmp):
        a, b = as_column(p.a), as_column(p.b)
        return df.where({"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b}[p.op])
    if isinstance(p, Prefix):
        return df.where(as_column(p.whole).startswith(as_column(p.part)))
    if isinstance(p, Call):
        return filtered(df, Elem(p.terms, p.rule.rows()))
    if isinstance(p, Elem):
        other = p.rows.toDF(*(f"__e{i}" for i in range(len(p.rows.columns))))
        test = F.lit(True)
        for i, t in enumerate(p.terms):
            test = test & as_column(t).eqNullSafe(F.col(f"__e{i}"))
        return df.join(other, test, "left_semi")
    columns = df.columns
    if isinstance(p, Not):
        held = filtered(df, p.part).distinct()
        return df.join(held.toDF(*(f"__h{c}" for c in columns)), all_equal(columns, "__h"), "left_anti")
    if isinstance(p, Or):
        held = union([filtered(df, x) for x in p.parts])
        return df.join(held.toDF(*(f"__h{c}" for c in columns)), all_equal(columns, "__h"), "left_semi")
    if isinstance(p, Exists):
        return grounded(df, p.names, flattened(p.inner, And), {n: None for n in p.names}).select(*columns).distinct()
    raise RelError(f"no filter for {p}")


def all_equal(columns: list[str], prefix_: str) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).eqNullSafe(F.col(prefix_ + c))
    return test


# ---------------------------------------------------------------- intervals

Interval = tuple[float, float]
ALL: Interval = (-math.inf, math.inf)


def meet(a: Interval, b: Interval) -> Interval:
    return max(a[0], b[0]), min(a[1], b[1])


def times(a: Interval, b: Interval) -> Interval:
    ends = [0.0 if x == 0 or y == 0 else x * y for x in a for y in b]
    return min(ends), max(ends)


def forward(t: Term, box: dict[str, Interval]) -> Interval:
    if isinstance(t, Sym):
        return box.get(t.name, ALL)
    if isinstance(t, Lit):
        return (t.value, t.value) if isinstance(t.value, int) and not isinstance(t.value, bool) else ALL
    a = [forward(x, box) for x in t.args]
    if t.op == "+":
        return a[0][0] + a[1][0], a[0][1] + a[1][1]
    if t.op == "-":
        return a[0][0] - a[1][1], a[0][1] - a[1][0]
    if t.op == "*":
        return times(*a)
    if t.op == "mod":
        k = t.args[1].value
        return (0, k - 1) if k > 0 else (k + 1, 0)
    lo, hi = a[0]
    return (0 if lo <= 0 <= hi else min(abs(lo), abs(hi))), max(abs(lo), abs(hi))


def backward(t: Term, want: Interval, box: dict[str, Interval]) -> None:
    """Narrows the variables of t so that its value can be in want."""
    if isinstance(t, Sym):
        lo, hi = meet(box.get(t.name, ALL), want)
        box[t.name] = (math.ceil(lo) if math.isfinite(lo) else lo, math.floor(hi) if math.isfinite(hi) else hi)
    elif isinstance(t, Arith):
        if t.op in "+-":
            a, b = (forward(x, box) for x in t.args)
            sign = 1 if t.op == "+" else -1
            backward(t.args[0], (want[0] - sign * b[sign > 0], want[1] - sign * b[sign < 0]) if sign > 0 else (want[0] + b[0], want[1] + b[1]), box)
            backward(t.args[1], (want[0] - a[1], want[1] - a[0]) if sign > 0 else (a[0] - want[1], a[1] - want[0]), box)
        elif t.op == "*":
            for x, y in (t.args, t.args[::-1]):
                lo, hi = forward(y, box)
                if lo > 0 or hi < 0:
                    inverse = (1 / hi if math.isfinite(hi) else 0.0, 1 / lo if math.isfinite(lo) else 0.0)
                    lo2, hi2 = times(want, inverse)
                    backward(x, (lo2 - 1e-9 * abs(lo2) if math.isfinite(lo2) else lo2, hi2 + 1e-9 * abs(hi2) if math.isfinite(hi2) else hi2), box)
        elif t.op == "abs" and want[1] < math.inf:
            backward(t.args[0], (-want[1], want[1]), box)


def intervals(conjuncts: list[Pred]) -> dict[str, Interval]:
    box: dict[str, Interval] = {}
    for _ in range(ROUNDS):
        before = dict(box)
        for c in conjuncts:
            if isinstance(c, Cmp) and c.op != "<>":
                a, b = forward(c.a, box), forward(c.b, box)
                strict = 1 if c.op == "<" else 0
                if c.op == "=":
                    backward(c.a, b, box)
                    backward(c.b, a, box)
                else:
                    backward(c.a, (-math.inf, b[1] - strict), box)
                    backward(c.b, (a[0] + strict, math.inf), box)
        if box == before:
            break
    return box


# ---------------------------------------------------------------- generators


def finite(spark: SparkSession, name: str, kind) -> DataFrame | None:
    """The extent of a type with few values: bool, char, or a list of constants."""
    if kind is bool:
        return spark.createDataFrame([(False,), (True,)], f"`{name}` boolean")
    if kind == "char":
        return spark.range(256).select(F.chr("id").alias(name))
    if isinstance(kind, list | tuple):
        return spark.createDataFrame([(v,) for v in kind], [name])
    return None


def crossed(df: DataFrame | None, other: DataFrame) -> DataFrame:
    return other if df is None else df.crossJoin(other)


def scanned(e: Elem, df: DataFrame | None) -> DataFrame:
    """df joined with the collection's rows on what is bound; its free variables become columns."""
    bound = set(df.columns) if df is not None else set()
    rows = e.rows.toDF(*(f"__e{i}" for i in range(len(e.rows.columns))))
    out: dict[str, Column] = {}
    test, keep = F.lit(True), F.lit(True)
    for i, t in enumerate(e.terms):
        c = F.col(f"__e{i}")
        if isinstance(t, Sym) and t.name not in bound:
            if t.name in out:
                keep = keep & (c == out[t.name])
            else:
                out[t.name] = c
        elif isinstance(t, Lit):
            keep = keep & (c == F.lit(t.value))
        elif names_in(t) <= bound:
            test = test & as_column(t).eqNullSafe(c)
    rows = rows.where(keep)
    joined = rows if df is None else df.join(rows, test)
    return joined.select(*([] if df is None else [F.col(c) for c in df.columns]), *(c.alias(n) for n, c in out.items()))


def grounded(df: DataFrame | None, names, conjuncts: list[Pred], kinds: dict) -> DataFrame:
    """df with a column for each name, for all assignments that the conjuncts allow."""
    spark = SparkSession.getActiveSession()
    todo = list(conjuncts)
    free = [n for n in names]
    box = intervals(conjuncts)
    while True:
        bound = set(df.columns) if df is not None else set()
        free = [n for n in free if n not in bound]
        wanted = set(free)

        def usable(p: Pred, wanted=wanted) -> bool:
            return bool(names_in(p) & wanted)

        todo = [Elem(p.terms, p.rule.rows()) if isinstance(p, Call) and usable(p) else p for p in todo]
        chosen = None
        for p in todo:  # collections first, the ones that share bound variables before others
            if isinstance(p, Elem) and usable(p) and (chosen is None or len(names_in(p) & bound) > len(names_in(chosen) & bound)):
                if all(isinstance(t, Sym | Lit) or names_in(t) <= bound for t in p.terms):
                    chosen = p
        if chosen is not None and (not bound or names_in(chosen) & bound or not any(isinstance(p, Cmp) and p.op == "=" and solved_for(p, bound, wanted) for p in todo)):
            df = scanned(chosen, df).distinct()
            todo = [p for p in todo if p is not chosen]
            continue
        equal = next(((p, *solved_for(p, bound, wanted)) for p in todo if isinstance(p, Cmp) and p.op == "=" and solved_for(p, bound, wanted)), None)
        if equal:
            p, name, value = equal
            df = (spark.range(1).select() if df is None else df).withColumn(name, as_column(value))
            todo = [x for x in todo if x is not p]
            continue
        if not free:
            break
        inner = next((p for p in todo if isinstance(p, Exists) and usable(p)), None)
        if inner is not None:
            more = [*inner.names, *(n for n in free if n in names_in(inner))]
            try:
                found = grounded(None, sorted(names_in(inner) | set(inner.names)), flattened(inner.inner, And), kinds)
                df, todo = joined_on(df, found.select(*sorted(names_in(inner))).distinct()), [x for x in todo if x is not inner]
                continue
            except NotGrounded:
                if df is not None:
                    try:
                        df = grounded(df, more, flattened(inner.inner, And), kinds).drop(*inner.names).distinct()
                        todo = [x for x in todo if x is not inner]
                        continue
                    except NotGrounded:
                        pass
        started = next((p for p in todo if isinstance(p, Prefix) and isinstance(p.part, Sym) and p.part.name in wanted and names_in(p.whole) <= bound), None)
        if started is not None:
            whole = as_column(started.whole)
            df = (spark.range(1).select() if df is None else df).withColumn(started.part.name, F.explode(F.transform(F.sequence(F.lit(0), F.char_length(whole)), lambda i: F.left(whole, i))))
            todo = [x for x in todo if x is not started]
            continue
        either = alternatives(df, free, todo, kinds)
        if either is not None:
            df, used = either
            todo = [x for x in todo if x is not used]
            continue
        ranged = [n for n in free if n in box and math.isfinite(box[n][0]) and math.isfinite(box[n][1]) and box[n][1] - box[n][0] < LARGEST]
        if ranged:
            name = min(ranged, key=lambda n: box[n][1] - box[n][0])
            lo, hi = map(int, box[name])
            df = crossed(df, spark.range(lo, max(lo, hi + 1)).select(F.col("id").cast("int").alias(name)))
            continue
        limits = variable_bounds(free, todo, bound)
        if limits is not None:
            name, lo, hi = limits
            df = df.withColumn(name, F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
            continue
        small = next(((n, finite(spark, n, kinds.get(n))) for n in free if finite(spark, n, kinds.get(n)) is not None), None)
        if small is not None:
            df = crossed(df, small[1])
            continue
        raise NotGrounded(free[0])
    df = spark.range(1).select() if df is None else df
    for p in todo:
        df = filtered(df, p)
    return df


def solved_for(p: Cmp, bound: set[str], wanted: set[str]):
    """(variable, expression of bound variables) of an equality, through one addition or subtraction."""
    for a, b in ((p.a, p.b), (p.b, p.a)):
        if not names_in(b) <= bound:
            continue
        if isinstance(a, Sym) and a.name in wanted:
            return a.name, b
        if isinstance(a, Arith) and a.op in "+-":
            x, y = a.args
            if isinstance(x, Sym) and x.name in wanted and names_in(y) <= bound:
                return x.name, (b - y if a.op == "+" else b + y)
            if isinstance(y, Sym) and y.name in wanted and names_in(x) <= bound:
                return y.name, (b - x if a.op == "+" else x - b)
    return None


def joined_on(df: DataFrame | None, other: DataFrame) -> DataFrame:
    if df is None:
        return other
    shared = [c for c in other.columns if c in df.columns]
    return df.join(other, shared) if shared else df.crossJoin(other)


def alternatives(df: DataFrame | None, free: list[str], todo: list[Pred], kinds: dict):
    """Of an alternative whose branches all generate the same free variables: the union of the branches."""
    for p in todo:
        if isinstance(p, Or) and (needed := [n for n in free if n in names_in(p)]):
            try:
                branches = [grounded(df, needed, flattened(b, And), kinds) for b in flattened(p, Or)]
            except NotGrounded:
                continue
            columns = [*(df.columns if df is not None else []), *needed]
            return union([b.select(*columns) for b in branches]), p
    return None


def variable_bounds(free: list[str], todo: list[Pred], bound: set[str]):
    """(name, lowest, highest) of a variable between expressions of bound ones."""
    for n in free:
        lows, highs = [], []
        for p in todo:
            if isinstance(p, Cmp) and p.op in ("<", "<="):
                step = 1 if p.op == "<" else 0
                if isinstance(p.b, Sym) and p.b.name == n and names_in(p.a) <= bound:
                    lows.append(as_column(p.a) + step)
                if isinstance(p.a, Sym) and p.a.name == n and names_in(p.b) <= bound:
                    highs.append(as_column(p.b) - step)
        if lows and highs and bound:
            return n, (F.greatest(*lows) if len(lows) > 1 else lows[0]).cast("int"), (F.least(*highs) if len(highs) > 1 else highs[0]).cast("int")
    return None


def solve(names, p: Pred, ordered: bool = True) -> DataFrame:
    """Every assignment of the names, once; names may be a dict of types (int, str, bool, "char", or a list of constants)."""
    kinds = names if isinstance(names, dict) else {n: None for n in names}
    df = grounded(None, list(kinds), flattened(p, And), kinds).select(*kinds).distinct()
    return df.orderBy(*kinds) if ordered else df


def syms(names: str) -> tuple[Sym, ...]:
    return tuple(Sym(n) for n in names.split())
