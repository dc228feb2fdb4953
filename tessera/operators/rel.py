"""Rel: a query pipeline whose steps are DataFrame plans.

A Rel has variables. A record variable is one column for each field (``e$deptno``), so that pruning and
pushdown see plain columns; a variable that an outer join made optional has a flag column (``e$?``) that
tells a missing row from a row of nulls. Steps take Python functions whose parameters name the variables
they use: ``rel.where(lambda e, d: e.deptno == d.deptno)``. They are called once, when the plan is made.

A list keeps hidden sort columns, a bag has none. They cost nothing until something reads the order:
``ordinal``, ``take``/``skip``, a list-valued aggregate or the final result.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.errors import PlacementError, RelError

FLAG = "?"
_fresh = itertools.count()


@dataclass(frozen=True)
class Var:
    """A variable's shape: fields of a record (None: one bare value), and whether it may be missing."""

    fields: tuple[str, ...] | None = None
    optional: bool = False


@dataclass(frozen=True)
class Key:
    """A hidden sort column."""

    column: str
    desc: bool = False

    def sort(self) -> Column:
        return F.col(self.column).desc_nulls_last() if self.desc else F.col(self.column).asc_nulls_first()


class Desc:
    """Marks a sort key, or a part of one, as descending."""

    def __init__(self, key):
        self.key = key


DESC = Desc


def column(var: str, field: str | None = None) -> str:
    return var if field is None else f"{var}${field}"


class Record:
    """What a step's function gets for a record variable."""

    def __init__(self, name: str, var: Var):
        object.__setattr__(self, "_name", name)
        object.__setattr__(self, "_var", var)

    def __getattr__(self, field: str) -> Column:
        if field.startswith("__") or field not in self._var.fields:
            raise AttributeError(f"no field '{field}' in {self._name}: {list(self._var.fields)}")
        return F.col(column(self._name, field))

    def __getitem__(self, field: str) -> Column:
        return getattr(self, field)

    @property
    def is_some(self) -> Column:
        return F.col(column(self._name, FLAG)).isNotNull() if self._var.optional else F.lit(True)

    @property
    def is_none(self) -> Column:
        return ~self.is_some

    @property
    def value(self) -> Column:
        """The whole record; of an optional variable null where it is missing."""
        whole = F.struct(*(F.col(column(self._name, f)).alias(f) for f in self._var.fields))
        return F.when(self.is_some, whole) if self._var.optional else whole


def canonical(names) -> list[str]:
    """A record's label order: numbers by value, then names."""
    return sorted(names, key=lambda n: (0, int(n), "") if n.isdigit() else (1, 0, n))


def value_of(x) -> Column:
    if isinstance(x, Record):
        return x.value
    if isinstance(x, dict):
        return F.struct(*(value_of(x[k]).alias(k) for k in canonical(x)))
    if isinstance(x, tuple):
        return F.struct(*(value_of(v).alias(f"_{i}") for i, v in enumerate(x, 1)))
    return x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    vars: dict[str, Var]
    keys: tuple[Key, ...] | None = None  # None: a bag
    row: str | None = None  # the sole variable whose value is the row

    # ------------------------------------------------------------------ sources

    @staticmethod
    def bag(df: DataFrame, name: str = "row") -> Rel:
        """A DataFrame's rows as a bag of records."""
        return Rel(df.select(*(F.col(f"`{c}`").alias(column(name, c)) for c in df.columns)), {name: Var(tuple(df.columns))}, None, name)

    @staticmethod
    def list(df: DataFrame, by: list[str], name: str = "row") -> Rel:
        """A DataFrame's rows as a list in the order of columns, which must tell rows apart for a definite order."""
        hidden = [f"__o{next(_fresh)}" for _ in by]
        made = df.select(*(F.col(f"`{c}`").alias(column(name, c)) for c in df.columns), *(F.col(f"`{c}`").alias(h) for c, h in zip(by, hidden, strict=True)))
        return Rel(made, {name: Var(tuple(df.columns))}, tuple(Key(h) for h in hidden), name)

    @staticmethod
    def literal(spark: SparkSession, rows: list, schema: str, ordered: bool = True, name: str = "row") -> Rel:
        """An in-memory list (or bag): a schema of one type makes bare values, one with names records."""
        fields = T._parse_datatype_string(schema)
        record = isinstance(fields, T.StructType)
        kind = fields if record else T.StructType([T.StructField("value", fields)])
        hidden = f"__o{next(_fresh)}"
        tuples = [(*((r[f] for f in kind.names) if isinstance(r, dict) else r if record else (r,)), i) for i, r in enumerate(rows)]
        df = spark.createDataFrame(tuples, T.StructType([*kind.fields, T.StructField(hidden, T.LongType())]))
        named = df.select(*(F.col(f"`{f}`").alias(column(name, f) if record else name) for f in kind.names), hidden)
        return Rel(named if ordered else named.drop(hidden), {name: Var(tuple(kind.names) if record else None)}, (Key(hidden),) if ordered else None, name)

    @staticmethod
    def range(spark: SparkSession, lo: int, hi: int, name: str = "row") -> Rel:
        """The integers lo, ..., hi as a list."""
        hidden = f"__o{next(_fresh)}"
        df = spark.range(lo, hi + 1).select(F.col("id").alias(name), F.col("id").alias(hidden))
        return Rel(df, {name: Var()}, (Key(hidden),), name)

    @staticmethod
    def unit(spark: SparkSession) -> Rel:
        """One row without variables: a query without a scan."""
        return Rel(spark.range(1).select(), {}, ())

    # ------------------------------------------------------------------ helpers

    @property
    def ordered(self) -> bool:
        return self.keys is not None

    def columns(self, name: str) -> list[str]:
        var = self.vars[name]
        own = [column(name)] if var.fields is None else [column(name, f) for f in var.fields]
        return own + ([column(name, FLAG)] if var.optional else [])

    def hidden(self) -> list[str]:
        return [k.column for k in self.keys or ()]

    def visible(self) -> list[str]:
        return [c for v in self.vars for c in self.columns(v)]

    def get(self, name: str):
        """What a function sees for a variable: a record, or a bare column."""
        var = self.vars[name]
        return F.col(name) if var.fields is None else Record(name, var)

    def call(self, f, extra: dict[str, Any] | None = None):
        """f with the variables that its parameters name."""
        if not callable(f):
            return f
        given = {}
        for p in inspect.signature(f).parameters.values():
            if p.kind is p.VAR_KEYWORD:
                given |= {v: self.get(v) for v in self.vars}
            elif extra and p.name in extra:
                given[p.name] = extra[p.name]
            elif p.name in self.vars:
                given[p.name] = self.get(p.name)
            elif p.name == "current":
                given[p.name] = self.current()
            elif p.default is p.empty:
                raise RelError(f"unbound variable '{p.name}': {list(self.vars)}")
        return f(**given)

    def current(self):
        """The row: the sole variable, or a record of all."""
        if len(self.vars) == 1:
            return self.get(next(iter(self.vars)))
        return F.struct(*(value_of(self.get(v)).alias(v) for v in canonical(self.vars)))

    def renamed(self, name: str) -> Rel:
        """The whole row as one variable."""
        if len(self.vars) == 1:
            (old,) = self.vars
            if old == name:
                return self
            var = self.vars[old]
            pairs = [(c, name + c[len(old) :]) for c in self.columns(old)]
            return Rel(self.df.select(*(F.col(a).alias(b) for a, b in pairs), *self.hidden()), {name: var}, self.keys, name)
        fields = canonical(self.vars)
        return Rel(self.df.select(*(value_of(self.get(v)).alias(column(name, v)) for v in fields), *self.hidden()), {name: Var(tuple(fields))}, self.keys, name)

    def project(self, exprs: dict[str, Any], row: str | None) -> Rel:
        """New variables in place of the old ones."""
        made, vars_ = [], {}
        for name, x in exprs.items():
            if isinstance(x, Record):
                made += [F.col(column(x._name, f)).alias(column(name, f)) for f in x._var.fields]
                if x._var.optional:
                    made.append(F.col(column(x._name, FLAG)).alias(column(name, FLAG)))
                vars_[name] = x._var
            elif isinstance(x, dict):
                made += [value_of(v).alias(column(name, f)) for f, v in x.items()]
                vars_[name] = Var(tuple(canonical(x)))
            else:
                made.append(value_of(x).alias(name))
                vars_[name] = Var()
        return Rel(self.df.select(*made, *self.hidden()), vars_, self.keys, row)

    # ------------------------------------------------------------------ scans and joins

    def scan(self, name: str, source, on: Callable | None = None, how: str = "inner") -> Rel:
        """``name in source``: a Rel (independent of the variables), or a function of them to an array (lateral).

        how: inner, left, right or full. The variables of a side that may be missing become optional.
        """
        if callable(source) and not isinstance(source, Rel):
            return self._lateral(name, source, on, how)
        if name in self.vars:
            raise RelError(f"duplicate variable '{name}'")
        right = (Rel.bag(source) if isinstance(source, DataFrame) else source).renamed(name)
        left, keys = self, None
        if left.ordered and right.ordered:
            keys = (*left.keys, *right.keys)
        if not left.vars and how == "inner" and on is None and not left.keys:
            return Rel(right.df, right.vars, right.keys, name)
        if how in ("right", "full"):
            left = left._flagged()
        if how in ("left", "full"):
            right = right._flagged()
        both = Rel(left.df, left.vars | right.vars)
        # the condition sees the values themselves, before either side can be missing
        condition = None if on is None else value_of(Rel(both.df, {v: replace(x, optional=False) for v, x in both.vars.items()}).call(on))
        if condition is None:
            df = left.df.crossJoin(right.df) if how == "inner" else left.df.join(right.df, F.lit(True), how)
        else:
            df = left.df.join(right.df, condition, how)
        if how in ("right", "full") and keys:
            # rows of the right side without a partner come last, in their own order
            tail = f"__o{next(_fresh)}"
            some = next(iter(left.vars))
            df = df.withColumn(tail, F.col(column(some, FLAG)).isNull())
            keys = (Key(tail), *keys)
        return Rel(df, both.vars, keys)

    def _flagged(self) -> Rel:
        """Every variable optional, with a flag that says the row is there."""
        df, vars_ = self.df, {}
        for v, x in self.vars.items():
            if not x.optional:
                df = df.withColumn(column(v, FLAG), F.lit(True))
            vars_[v] = replace(x, optional=True)
        return Rel(df, vars_, self.keys, self.row)

    def _lateral(self, name: str, source: Callable, on: Callable | None, how: str) -> Rel:
        if how not in ("inner", "left"):
            raise RelError("the source of a right or full join may not depend on the variables")
        array = self.call(source)
        place = f"__o{next(_fresh)}"
        if how == "left" and on is not None:
            inner = self._element_type(array, name)
            array = F.filter(array, lambda x: value_of(self.call(on, {name: _Element(x)})) if inner is None else value_of(self.call(on, {name: x})))
            on = None
        explode = F.posexplode_outer if how == "left" else F.posexplode
        df = self.df.select("*", explode(array).alias(place, name))
        var = Var()
        kind = df.schema[name].dataType
        if isinstance(kind, T.StructType):
            var = Var(tuple(kind.names))
            df = df.select(*(c for c in df.columns if c != name), *(F.col(f"{name}.`{f}`").alias(column(name, f)) for f in kind.names))
        if how == "left":
            df = df.withColumn(column(name, FLAG), F.when(F.col(place).isNotNull(), True))
            var = replace(var, optional=True)
        keys = None if self.keys is None else (*self.keys, Key(place))
        out = Rel(df if keys else df.drop(place), self.vars | {name: var}, keys)
        return out if on is None else out.where(on)

    def _element_type(self, array: Column, name: str):
        kind = self.df.select(array.alias(name)).schema[name].dataType.elementType
        return None if isinstance(kind, T.StructType) else kind

    def join(self, name: str, source, on: Callable | None = None) -> Rel:
        return self.scan(name, source, on)

    def left_join(self, name: str, source, on: Callable | None = None) -> Rel:
        return self.scan(name, source, on, "left")

    def right_join(self, name: str, source, on: Callable | None = None) -> Rel:
        return self.scan(name, source, on, "right")

    def full_join(self, name: str, source, on: Callable | None = None) -> Rel:
        return self.scan(name, source, on, "full")

    def let(self, name: str, value) -> Rel:
        """``name = value``: a scan of one row."""
        x = self.call(value)
        df = self.df.select("*", *([value_of(v).alias(column(name, f)) for f, v in x.items()] if isinstance(x, dict) else [value_of(x).alias(name)]))
        return Rel(df, self.vars | {name: Var(tuple(canonical(x)) if isinstance(x, dict) else None)}, self.keys)

    def match(self, name: str, pattern: dict[str, Any] | tuple, bind: dict[str, str] | None = None) -> Rel:
        """A destructuring scan: rows whose fields equal the pattern's constants stay, and bind's fields become variables."""
        record = self.get(name)
        test = F.lit(True)
        for f, x in (pattern if isinstance(pattern, dict) else {f"_{i}": v for i, v in enumerate(pattern, 1)}).items():
            test = test & record[f].eqNullSafe(F.lit(x))
        out = self.where(lambda **_: test)
        for var, field in (bind or {}).items():
            out = out.let(var, lambda field=field: record[field])
        return out

    def semi(self, name: str, source: Rel, on: Callable) -> Rel:
        """Rows with a partner: ``where exists (from name in source where on)``."""
        return self._filtered_by(name, source, on, "left_semi")

    def anti(self, name: str, source: Rel, on: Callable) -> Rel:
        """Rows without a partner."""
        return self._filtered_by(name, source, on, "left_anti")

    def _filtered_by(self, name: str, source: Rel, on: Callable, how: str) -> Rel:
        right = source.renamed(name)
        right = Rel(right.df.drop(*right.hidden()), right.vars)
        condition = value_of(Rel(self.df, self.vars | right.vars).call(on))
        return replace(self, df=self.df.join(right.df, condition, how))

    def elem(self, value: Callable, source: Rel) -> Rel:
        """``where value elem source``. There are no nulls: a missing value equals a missing value."""
        return self.semi("__x", source, self._equal_to(value, source))

    def notelem(self, value: Callable, source: Rel) -> Rel:
        return self.anti("__x", source, self._equal_to(value, source))

    def _equal_to(self, value: Callable, source: Rel) -> Callable:
        mine = self.call(value)
        fields = source.renamed("__x").vars["__x"].fields

        def on(**_):
            if fields is None:
                return value_of(mine).eqNullSafe(F.col("__x"))
            test = F.lit(True)
            for f in fields:
                own = mine[f] if isinstance(mine, dict | Record) else value_of(mine).getField(f)
                test = test & value_of(own).eqNullSafe(F.col(column("__x", f)))
            return test

        return on

    # ------------------------------------------------------------------ filter and project

    def where(self, p: Callable) -> Rel:
        return replace(self, df=self.df.where(value_of(self.call(p))))

    def yield_(self, e, name: str | None = None) -> Rel:
        """Project: a dict rebinds the variables to its fields; any other value is the row; name binds the whole row."""
        x = self.call(e)
        if name is not None:
            return self.project({name: x}, name)
        if isinstance(x, dict):
            return self.project(x, None)
        return self.project({x._name if isinstance(x, Record) else "it": x}, x._name if isinstance(x, Record) else "it")

    def yield_all(self, e: Callable, name: str = "it") -> Rel:
        """Each element of a collection becomes a row; empty ones vanish."""
        out = self._lateral(name, e, None, "inner")
        kept = Rel(out.df, {name: out.vars[name]}, out.keys, name)
        return Rel(kept.df.select(*kept.visible(), *kept.hidden()), kept.vars, kept.keys, name)

    def distinct(self) -> Rel:
        """A row for each different one, in the order of first appearance."""
        if not self.vars:
            return replace(self, df=self.df.limit(1))
        if not self.keys:
            return replace(self, df=self.df.select(*self.visible()).distinct())
        df, key = self._first_place(self.df.groupBy(*(F.col(c) for c in self.visible())), [])
        return Rel(df, self.vars, (key,), self.row)

    def _first_place(self, grouped, aggregates: list[Column]) -> tuple[DataFrame, Key]:
        """Aggregates a group with its first place in the order."""
        rel = self._simple_keys()
        if rel is not self:
            raise RelError("sort keys of both directions need ordinal_keys() first")
        place, desc = f"__o{next(_fresh)}", bool(self.keys) and self.keys[0].desc
        whole = F.struct(*(F.col(k.column) for k in self.keys)) if self.keys else F.lit(0)
        return grouped.agg(*aggregates, (F.max(whole) if desc else F.min(whole)).alias(place)), Key(place, desc)

    def _simple_keys(self) -> Rel:
        """Keys of one direction, so that first places can be compared as one value."""
        return self if not self.keys or len({k.desc for k in self.keys}) == 1 else self.ordinal_keys()

    # ------------------------------------------------------------------ order

    def order(self, key: Callable) -> Rel:
        """Sort by a value, a tuple or record of values, each perhaps Desc; ties keep their order."""
        made: list[tuple[Column, bool]] = []

        def add(x, desc: bool) -> None:
            if isinstance(x, Desc):
                add(x.key, not desc)
            elif isinstance(x, dict):
                for k in canonical(x):
                    add(x[k], desc)
            elif isinstance(x, tuple):
                for v in x:
                    add(v, desc)
            else:
                made.append((value_of(x), desc))

        add(self.call(key), False)
        names = [f"__o{next(_fresh)}" for _ in made]
        df = self.df.select("*", *(c.alias(n) for (c, _), n in zip(made, names, strict=True)))
        return Rel(df, self.vars, (*(Key(n, d) for n, (_, d) in zip(names, made, strict=True)), *(self.keys or ())), self.row)

    def unorder(self) -> Rel:
        return Rel(self.df.drop(*self.hidden()), self.vars, None, self.row)

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*(k.sort() for k in self.keys)) if self.keys else self.df

    def skip(self, n: int) -> Rel:
        return replace(self, df=self.sorted().offset(max(0, n)))

    def take(self, n: int) -> Rel:
        return replace(self, df=self.sorted().limit(max(0, n)))

    def take_by(self, outer: Callable, n, order: Callable | None = None) -> Rel:
        """The first n rows of each value of outer (n may be a function of the variables): a dependent take."""
        rel = self.order(order) if order is not None else self
        group = rel.call(outer)
        parts = [value_of(x) for x in (group if isinstance(group, tuple) else (group,))]
        sorts = [k.sort() for k in rel.keys or ()] or [F.lit(0)]
        count = f"__n{next(_fresh)}"
        df = rel.df.withColumn(count, F.row_number().over(Window.partitionBy(*parts).orderBy(*sorts)))
        return replace(rel, df=df.where(F.col(count) <= value_of(rel.call(n))).drop(count))

    def ordinal(self, name: str = "ordinal") -> Rel:
        """The 0-based place of each row as a variable.

        Rows are dealt by ranges of the sort keys; a row's place is its number in its range plus the sizes
        of the ranges before it, so no task holds all rows.
        """
        if not self.ordered:
            raise PlacementError("cannot use 'ordinal' in unordered query")
        df = self.df
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = f"__p{next(_fresh)}"
        sorts = [k.sort() for k in self.keys] or [F.lit(0)]
        from tessera.operators.shared import checkpointed

        dealt = checkpointed((df.repartitionByRange(parts, *sorts) if self.keys else df.coalesce(1)).withColumn(part, F.spark_partition_id()))
        sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__size"))
        before = sizes.select(part, (F.sum("__size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).alias("__before"))
        placed = dealt.join(F.broadcast(before), part)  # a row for each range
        number = F.row_number().over(Window.partitionBy(part).orderBy(*sorts)) - 1 + F.col("__before")
        df = placed.withColumn(name, number.cast("long")).drop(part, "__before")
        return Rel(df, self.vars | {name: Var()}, self.keys)

    def ordinal_keys(self) -> Rel:
        """The same list with its place as its only sort key."""
        name = f"__o{next(_fresh)}"
        out = self.ordinal(name)
        return Rel(out.df.drop(*self.hidden()), self.vars, (Key(name),), self.row)

    # ------------------------------------------------------------------ aggregation

    def group(self, keys=None, compute: dict[str, Any] | None = None, name: str | None = None) -> Rel:
        """``group keys compute {...}``: keys is a dict of names to functions, or variable or field names.

        An aggregate is a function of the variables to an aggregate column (see ``aggregates``). Without keys
        there is always exactly one row.
        """
        rel = self._simple_keys()
        exprs = rel._key_exprs(keys)
        aggs = {n: value_of(rel.call(f, {"elements": rel.elements()})) for n, f in (compute or {}).items()}
        if dup := set(exprs) & set(aggs):
            raise RelError(f"duplicate field '{sorted(dup)[0]}' in group")
        made = [x.alias(n) for n, x in aggs.items()]
        if not exprs:
            df = rel.df.agg(*made) if made else rel.df.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
            out = Rel(df, {n: Var() for n in aggs}, () if rel.ordered else None)
        else:
            grouped = rel.df.groupBy(*(x.alias(n) for n, x in exprs.items()))
            vars_ = {n: Var() for n in [*exprs, *aggs]}
            if rel.keys:
                df, key = rel._first_place(grouped, made)
                out = Rel(df, vars_, (key,))
            else:
                out = Rel(grouped.agg(*made) if made else rel.df.select(*(x.alias(n) for n, x in exprs.items())).distinct(), vars_, () if rel.ordered else None)
        return out.renamed(name) if name else out

    def _key_exprs(self, keys) -> dict[str, Column]:
        if keys is None or keys == () or keys == {}:
            return {}
        if isinstance(keys, str):
            keys = [keys]
        if isinstance(keys, dict):
            return {n: value_of(self.call(f)) for n, f in keys.items()}
        out = {}
        for k in keys:
            var, _, field = k.partition(".")
            out[field or var] = value_of(getattr(self.get(var), field) if field else self.get(var))
        return out

    def elements(self):
        """Inside compute: the group's rows as a collection, in order if the input is a list."""
        rows = value_of(self.current()) if self.vars else F.struct()
        if not self.keys:
            return F.collect_list(rows)
        pairs = F.sort_array(F.collect_list(F.struct(*(F.col(k.column).alias(f"k{i}") for i, k in enumerate(self.keys)), rows.alias("row"))), asc=not self.keys[0].desc)
        return F.transform(pairs, lambda p: p["row"])

    def compute(self, aggregates: dict[str, Any] | Callable) -> Rel:
        """The last step: aggregates over all rows, one row."""
        return self.group(None, aggregates if isinstance(aggregates, dict) else {"it": aggregates})

    # ------------------------------------------------------------------ set operations

    def _reconciled(self, others) -> tuple[DataFrame, list[DataFrame]]:
        """The rows of all sides with the same columns. A record of one field stands for its value."""
        mine = self.visible()
        rest = []
        for o in others:
            o = o if isinstance(o, Rel) else Rel.bag(o)
            theirs = o.visible()
            if len(theirs) != len(mine):
                raise RelError(f"set operation over rows of {len(mine)} and {len(theirs)} fields")
            suffix = lambda c: c.split("$")[-1]
            by = {suffix(c): c for c in theirs}
            order = [by[suffix(c)] for c in mine] if len(mine) > 1 and all(suffix(c) in by for c in mine) else theirs
            rest.append(o.df.select(*(F.col(b).alias(a) for a, b in zip(mine, order, strict=True)), *o.hidden()))
        return self.df, rest

    def union(self, *others, distinct: bool = False) -> Rel:
        """All rows of all sides; a list if every side is one, in the order of the sides."""
        ordered = self.ordered and all(isinstance(o, Rel) and o.ordered for o in others)
        if not ordered:
            df, rest = self.unorder()._reconciled([o.unorder() if isinstance(o, Rel) else o for o in others])
            for r in rest:
                df = df.unionByName(r)
            out = Rel(df, self.vars, None, self.row)
            return out.distinct() if distinct else out
        sides = [x.ordinal_keys() for x in (self, *others)]
        side, place = f"__o{next(_fresh)}", f"__o{next(_fresh)}"
        _, rest = sides[0]._reconciled(sides[1:])
        frames = [sides[0].df, *rest]
        made = [f.select(*self.visible(), F.lit(i).alias(side), F.col(s.keys[0].column).alias(place)) for i, (f, s) in enumerate(zip(frames, sides, strict=True))]
        df = made[0]
        for m in made[1:]:
            df = df.unionByName(m)
        out = Rel(df, self.vars, (Key(side), Key(place)), self.row)
        return out.distinct() if distinct else out

    def intersect(self, *others, distinct: bool = False) -> Rel:
        """Rows with the smallest number of times that any side has them."""
        return self._counted("intersect", others, distinct)

    def except_(self, *others, distinct: bool = False) -> Rel:
        """Rows with the number of times that is left; of a list the earliest go."""
        return self._counted("except", others, distinct)

    def _counted(self, kind: str, others, distinct: bool) -> Rel:
        df, rest = self._reconciled([o.unorder() if isinstance(o, Rel) else o for o in others])
        mine = self.visible()
        if not self.keys:
            for r in rest:
                df = df.select(*mine)
                if distinct:
                    df = df.intersect(r) if kind == "intersect" else df.subtract(r)
                else:
                    df = df.intersectAll(r) if kind == "intersect" else df.exceptAll(r)
            return Rel(df.distinct() if distinct else df, self.vars, None, self.row)
        counts = [r.groupBy(*(F.col(c).alias(f"__r{j}") for j, c in enumerate(mine))).agg(F.count(F.lit(1)).alias(f"__c{i}")) for i, r in enumerate(rest)]
        number = "__number"
        df = df.withColumn(number, F.row_number().over(Window.partitionBy(*mine).orderBy(*(k.sort() for k in self.keys))))
        for i, c in enumerate(counts):
            same = F.lit(True)
            for j, m in enumerate(mine):
                same = same & F.col(m).eqNullSafe(F.col(f"__r{j}"))
            df = df.join(c, same, "left").drop(*(f"__r{j}" for j in range(len(mine))))
        each = [F.coalesce(F.col(f"__c{i}"), F.lit(0)) for i in range(len(counts))]
        if kind == "intersect":
            keep = F.col(number) <= (F.least(*each) if len(each) > 1 else each[0])
        else:
            keep = F.col(number) > sum(each[1:], each[0])
        if distinct:
            keep = F.col(number).eqNullSafe(1)
            for e in each:
                keep = keep & ((e > 0) if kind == "intersect" else (e == 0))
        return replace(self, df=df.where(keep).drop(number, *(f"__c{i}" for i in range(len(counts)))))

    # ------------------------------------------------------------------ functions of whole collections

    def through(self, name: str, f: Callable[[Rel], Rel | DataFrame]) -> Rel:
        """f maps the whole collection to another, whose rows are named."""
        out = f(self)
        return (Rel.bag(out) if isinstance(out, DataFrame) else out).renamed(name)

    def into(self, f: Callable[[Rel], Any]) -> Any:
        """f reduces the whole collection; the last step."""
        return f(self)

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def forall(self, require: Callable) -> bool:
        return self.where(lambda **_: ~value_of(self.call(require))).df.isEmpty()

    def only(self) -> Any:
        """The single row's value; Empty or Size if there isn't exactly one."""
        rows = self.result().take(2)
        if len(rows) != 1:
            raise RelError("Empty" if not rows else "Size")
        return rows[0][0] if len(rows[0]) == 1 else rows[0]

    # ------------------------------------------------------------------ results

    def result(self) -> DataFrame:
        """The rows in order, record fields in canonical order; a sole record variable's fields are the columns."""
        df = self.sorted()
        if len(self.vars) == 1 and self.row:
            (name,) = self.vars
            var = self.vars[name]
            if var.fields is None or var.optional:
                return df.select(value_of(self.get(name)).alias(name))
            return df.select(*(F.col(column(name, f)).alias(f) for f in canonical(var.fields)))
        return df.select(*(value_of(self.get(v)).alias(v) for v in canonical(self.vars)))

    def collect(self) -> list:
        rows = self.result().collect()
        return [r[0] for r in rows] if len(self.vars) == 1 and self.row and self.vars[self.row].fields is None else rows


class _Element:
    """A record inside a lambda over an array."""

    def __init__(self, x: Column):
        self._x = x

    def __getattr__(self, field: str) -> Column:
        return self._x.getField(field)


def from_(source=None, name: str = "row", spark: SparkSession | None = None) -> Rel:
    """Begins a query: ``from name in source``, or without a source one row of no variables."""
    if source is None:
        return Rel.unit(spark or SparkSession.getActiveSession())
    return (Rel.bag(source) if isinstance(source, DataFrame) else source).renamed(name)
