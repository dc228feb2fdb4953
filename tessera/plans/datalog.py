"""A Datalog front end: programs become DataFrame plans, stratum by stratum, recursion by semi-naive rounds.

::

    .decl edge(x:int, y:int)
    .decl path(x:int, y:int)
    edge(1, 2). edge(2, 3).
    path(X, Y) :- edge(X, Y).
    path(X, Z) :- path(X, Y), edge(Y, Z).
    .output path

Relations are sets. A rule with several atoms of its own recursion is expanded once for each of them, so
every combination of new and known rows is formed; relations may be mutually recursive.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.errors import RelError
from tessera.operators.fixpoint import MERGE
from tessera.operators.shared import checkpointed

TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(?P<dir>\.(?:decl|input|output)\b)|(?P<str>\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>:-|!=|<=|>=|[-(),.:!=<>+*/])", re.S)
SPARK_TYPES = {"int": "int", "string": "string"}


class DatalogError(RelError):
    pass


#: What is said of a program that isn't valid.
NOT_DECLARED = "Relation '{}' used in {} but not declared"
OTHER_ARITY = "Atom {}/{} does not match declaration {}/{}"
OTHER_TYPE = "Type mismatch in {} {}(...): expected {}, got {} for parameter {}"
NO_CONSTANT = "Argument in fact is not constant: {}"
UNSAFE_HEAD = "Rule is unsafe. Variable '{}' in head does not appear in positive body atom"
UNSAFE_PART = "Rule is unsafe. Variable '{}' in {} does not appear in positive body atom"
NOT_STRATIFIED = "Program is not stratified. Negation cycle detected involving relation: {}"
INVALID = "Compilation error: {}"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: int | str


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple
    negated: bool = False


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple


@dataclass
class Program:
    decls: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)
    facts: list[Atom] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise DatalogError(f"unexpected character '{text[at]}'")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def next(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise DatalogError(f"expected '{want}', found '{got or 'the end'}'" if want else "unexpected end")
        self.at += 1
        return got

    def name(self) -> str:
        if self.kind() != "name":
            raise DatalogError(f"expected a name, found '{self.peek()}'")
        return self.next()

    def program(self) -> Program:
        p = Program()
        while self.at < len(self.tokens):
            word = self.peek()
            if word == ".decl":
                self.next()
                name = self.name()
                if name in p.decls:
                    raise DatalogError(f"relation '{name}' is declared twice")
                p.decls[name] = self.columns()
            elif word == ".input":
                self.next()
                name = self.name()
                p.inputs[name] = self.next()[1:-1] if self.kind() == "str" else f"{name}.csv"
            elif word == ".output":
                self.next()
                p.outputs.append(self.name())
            else:
                head = self.atom()
                if self.peek() == ":-":
                    self.next()
                    body = [self.literal()]
                    while self.peek() == ",":
                        self.next()
                        body.append(self.literal())
                    p.rules.append(Rule(head, tuple(body)))
                else:
                    p.facts.append(head)
                self.next(".")
        return p

    def columns(self) -> list[tuple[str, str]]:
        self.next("(")
        out = []
        while self.peek() != ")":
            name = self.name()
            self.next(":")
            kind = self.name()
            kind = {"number": "int", "symbol": "string"}.get(kind, kind)
            if kind not in SPARK_TYPES:
                raise DatalogError(f"unknown type '{kind}'")
            out.append((name, kind))
            if self.peek() == ",":
                self.next()
        self.next(")")
        return out

    def atom(self, negated: bool = False) -> Atom:
        name = self.name()
        self.next("(")
        args = []
        while self.peek() != ")":
            args.append(self.sum())
            if self.peek() == ",":
                self.next()
        self.next(")")
        return Atom(name, tuple(args), negated)

    def literal(self):
        if self.peek() == "!":
            self.next()
            return self.atom(True)
        if self.kind() == "name" and self.peek(1) == "(":
            return self.atom()
        left = self.sum()
        op = self.next()
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            raise DatalogError(f"expected a comparison, found '{op}'")
        return Compare(op, left, self.sum())

    def sum(self):
        x = self.product()
        while self.peek() in ("+", "-"):
            x = Arith(self.next(), x, self.product())
        return x

    def product(self):
        x = self.unit()
        while self.peek() in ("*", "/"):
            x = Arith(self.next(), x, self.unit())
        return x

    def unit(self):
        kind, text = self.kind(), self.next()
        if text == "(":
            x = self.sum()
            self.next(")")
            return x
        if text == "-":
            x = self.unit()
            return Const(-x.value) if isinstance(x, Const) else Arith("-", Const(0), x)
        if kind == "num":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            return Var(text)
        raise DatalogError(f"unexpected '{text}'")


def variables(x) -> set[str]:
    if isinstance(x, Var):
        return set() if x.name == "_" else {x.name}
    if isinstance(x, Arith):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Atom):
        return set().union(*map(variables, x.args)) if x.args else set()
    if isinstance(x, Compare):
        return variables(x.left) | variables(x.right)
    return set()


def strata(p: Program) -> list[list[str]]:
    """Groups of mutually recursive relations, those that others need first."""
    needs = {n: set() for n in p.decls}
    for r in p.rules:
        needs[r.head.name] |= {a.name for a in r.body if isinstance(a, Atom)}
    order: list[list[str]] = []
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in sorted(needs[v]):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            group = []
            while True:
                group.append(stack.pop())
                if group[-1] == v:
                    break
            order.append(sorted(group))

    for v in p.decls:
        if v not in index:
            visit(v)
    return order


def type_of(x, types: dict[str, str]) -> str:
    if isinstance(x, Const):
        return "int" if isinstance(x.value, int) else "string"
    if isinstance(x, Arith):
        for side in (x.left, x.right):
            if type_of(side, types) != "int":
                raise DatalogError("arithmetic over a value that is no int")
        return "int"
    return types.get(x.name, "int")


def check(p: Program) -> None:
    """Declarations, arity, types, safety and stratification."""
    def fits(a: Atom, place: str) -> None:
        if a.name not in p.decls:
            raise DatalogError(NOT_DECLARED.format(a.name, place))
        declared = p.decls[a.name]
        if len(a.args) != len(declared):
            raise DatalogError(OTHER_ARITY.format(a.name, len(a.args), a.name, len(declared)))
        for x, (column, kind) in zip(a.args, declared, strict=True):
            if isinstance(x, Const) and type_of(x, {}) != kind:
                raise DatalogError(OTHER_TYPE.format(place, a.name, kind, type_of(x, {}), column))

    for names, place in ((p.inputs, ".input"), (p.outputs, ".output")):
        for n in names:
            if n not in p.decls:
                raise DatalogError(NOT_DECLARED.format(n, place))
    for f in p.facts:
        fits(f, "fact")
        for x in f.args:
            if not isinstance(x, Const):
                raise DatalogError(NO_CONSTANT.format(x.name if isinstance(x, Var) else x))
    for r in p.rules:
        fits(r.head, "rule head")
        for a in r.body:
            if isinstance(a, Atom):
                fits(a, "rule body")
    group_of = {n: i for i, g in enumerate(strata(p)) for n in g}
    for r in p.rules:
        types: dict[str, str] = {}
        bound: set[str] = set()
        for a in r.body:
            if isinstance(a, Atom) and not a.negated:
                for x, (_, kind) in zip(a.args, p.decls[a.name], strict=True):
                    if isinstance(x, Var) and x.name != "_":
                        if types.setdefault(x.name, kind) != kind:
                            raise DatalogError(f"variable '{x.name}' is both {types[x.name]} and {kind}")
                        bound.add(x.name)
        while True:  # X = e binds X where e is bound
            more = {x.name for c in r.body if isinstance(c, Compare) and c.op == "=" for x, e in ((c.left, c.right), (c.right, c.left)) if isinstance(x, Var) and variables(e) <= bound} - bound
            if not more:
                break
            for c in r.body:
                if isinstance(c, Compare) and c.op == "=":
                    for x, e in ((c.left, c.right), (c.right, c.left)):
                        if isinstance(x, Var) and x.name in more:
                            types.setdefault(x.name, type_of(e, types))
            bound |= more
        for part, what in [(r.head, "head"), *((a, "negated atom") for a in r.body if isinstance(a, Atom) and a.negated), *((c, "comparison") for c in r.body if isinstance(c, Compare))]:
            if free := sorted(variables(part) - bound):
                raise DatalogError(UNSAFE_HEAD.format(free[0]) if what == "head" else UNSAFE_PART.format(free[0], what))
        if any(isinstance(x, Var) and x.name == "_" for x in r.head.args):
            raise DatalogError("'_' in head")
        for a in [r.head, *(a for a in r.body if isinstance(a, Atom))]:
            for x, (column, kind) in zip(a.args, p.decls[a.name], strict=True):
                if not (isinstance(x, Var) and x.name == "_") and type_of(x, types) != kind:
                    raise DatalogError(f"column '{column}' of '{a.name}' is {kind}")
        for c in r.body:
            if isinstance(c, Compare) and type_of(c.left, types) != type_of(c.right, types):
                raise DatalogError("comparison of an int and a string")
            if isinstance(c, Atom) and c.negated and group_of[c.name] == group_of[r.head.name]:
                raise DatalogError(NOT_STRATIFIED.format(r.head.name))


def expression(x) -> Column:
    if isinstance(x, Var):
        return F.col(x.name)
    if isinstance(x, Const):
        return F.lit(x.value)
    a, b = expression(x.left), expression(x.right)
    if x.op == "/":
        from tessera.functions.numbers import Int

        return Int.quot(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[x.op]


def comparison(c: Compare) -> Column:
    a, b = expression(c.left), expression(c.right)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]


def scan(a: Atom, df: DataFrame) -> DataFrame:
    """An atom's rows with a column for each variable; constants and repeated variables are filters."""
    out: dict[str, Column] = {}
    test = F.lit(True)
    for x, c in zip(a.args, df.columns, strict=True):
        if isinstance(x, Var) and x.name != "_":
            if x.name in out:
                test = test & (F.col(c) == out[x.name])
            else:
                out[x.name] = F.col(c)
        elif isinstance(x, Const):
            test = test & (F.col(c) == F.lit(x.value))
    return df.where(test).select(*(x.alias(n) for n, x in out.items()))


def evaluate(r: Rule, relation, columns: list[tuple[str, str]]) -> DataFrame:
    """The head's rows. relation(i, name): what the i-th literal reads."""
    df = None
    pending = [c for c in r.body if isinstance(c, Compare)]
    later: list[Compare] = []
    for i, a in enumerate(r.body):
        if isinstance(a, Atom) and not a.negated:
            computed = [(j, x) for j, x in enumerate(a.args) if isinstance(x, Arith)]
            args = tuple(Var(f"__a{i}_{j}") if isinstance(x, Arith) else x for j, x in enumerate(a.args))
            later += [Compare("=", Var(f"__a{i}_{j}"), x) for j, x in computed]
            rows = scan(Atom(a.name, args), relation(i, a.name))
            if df is None:
                df = rows
            else:
                shared = [c for c in rows.columns if c in df.columns]
                df = df.join(rows, shared) if shared else df.crossJoin(rows)
    pending += later
    if df is None:
        df = relation(None, None)
    while pending:
        for c in pending:
            if variables(c) <= set(df.columns):
                df = df.where(comparison(c))
                break
            x, e = (c.left, c.right) if isinstance(c.left, Var) and c.left.name not in df.columns else (c.right, c.left)
            if c.op == "=" and isinstance(x, Var) and variables(e) <= set(df.columns):
                df = df.withColumn(x.name, expression(e))
                break
        else:
            raise DatalogError("a comparison's variables are not bound")
        pending.remove(c)
    for i, a in enumerate(r.body):
        if isinstance(a, Atom) and a.negated:
            other = relation(i, a.name)
            other = other.toDF(*(f"__n{j}" for j in range(len(other.columns))))
            test = F.lit(True)
            for j, x in enumerate(a.args):
                if not (isinstance(x, Var) and x.name == "_"):
                    test = test & (F.col(f"__n{j}") == expression(x))
            df = df.join(other, test, "left_anti")
    return df.select(*(expression(x).cast(SPARK_TYPES[kind]).alias(n) for x, (n, kind) in zip(r.head.args, columns, strict=True)))


def solve(spark: SparkSession, p: Program, given: dict[str, DataFrame] | None = None, folder: str = ".") -> dict[str, DataFrame]:
    """Every relation of a checked program. given: rows of relations that are DataFrames already."""
    from tessera.sources.tables import strict

    base: dict[str, DataFrame] = {}
    for name, columns in p.decls.items():
        schema = ", ".join(f"`{n}` {SPARK_TYPES[k]}" for n, k in columns) or "__unit int"
        facts = [tuple(x.value for x in f.args) for f in p.facts if f.name == name]
        df = spark.createDataFrame(facts, schema)
        if name in p.inputs:
            df = df.unionByName(strict(spark, f"{folder}/{p.inputs[name]}", columns))
        if given and name in given:
            df = df.union(given[name].select(*(F.col(c).cast(SPARK_TYPES[k]).alias(n) for c, (n, k) in zip(given[name].columns, columns, strict=True))))
        base[name] = df
    known = dict(base)
    unit = spark.range(1).select()
    for group in strata(p):
        rules = [r for r in p.rules if r.head.name in group]
        recursive = {id(r): [i for i, a in enumerate(r.body) if isinstance(a, Atom) and a.name in group] for r in rules}
        for name in group:
            rows = base[name]
            for r in rules:
                if r.head.name == name and not recursive[id(r)]:
                    rows = rows.unionByName(evaluate(r, lambda i, n: unit if n is None else known[n], p.decls[name]))
            known[name] = rows.distinct()
        if not any(recursive.values()):
            continue
        total = {n: checkpointed(known[n]) for n in group}
        new = dict(total)
        for rounds in itertools.count(1):  # until a round finds no new fact
            made: dict[str, DataFrame] = {}
            for r in rules:
                for at in recursive[id(r)]:  # one term for each recursive atom: it reads the new rows, the others all
                    rows = evaluate(r, lambda i, n, at=at: unit if n is None else new[n] if i == at else total.get(n, known[n]), p.decls[r.head.name])
                    made[r.head.name] = made[r.head.name].unionByName(rows) if r.head.name in made else rows
            fresh = {n: checkpointed(made[n].distinct().join(total[n], total[n].columns, "left_anti").select(*total[n].columns)) if n in made else total[n].limit(0) for n in group}
            if all(d.isEmpty() for d in fresh.values()):
                break
            total = {n: total[n].unionByName(fresh[n]) for n in group}
            if rounds % MERGE == 0:  # the rounds' tables are read one by one until then
                total = {n: checkpointed(x) for n, x in total.items()}
            new = fresh
        known |= total
    return known


def parse(text: str) -> Program:
    return Parser(text).program()


def execute(spark: SparkSession, text: str, given: dict[str, DataFrame] | None = None, folder: str = ".") -> dict[str, DataFrame]:
    """The relations that the program outputs."""
    p = parse(text)
    check(p)
    known = solve(spark, p, given, folder)
    return {n: known[n] for n in p.outputs}


def validate(text: str) -> str:
    """The type of the program's result, or what is wrong with it."""
    try:
        p = parse(text)
        check(p)
    except DatalogError as e:
        return INVALID.format(e)
    if not p.outputs:
        return "unit"
    return "{" + ", ".join(f"{n}:{{{', '.join(f'{c}:{k}' for c, k in sorted(p.decls[n]))}}} list" for n in sorted(p.outputs)) + "}"


def translate(spark: SparkSession, text: str, given: dict[str, DataFrame] | None = None) -> str | None:
    """The plans that a program becomes, or None for a program that isn't valid."""
    try:
        found = execute(spark, text, given)
    except DatalogError:
        return None
    return "\n".join(f"-- {n}\n{df._jdf.queryExecution().optimizedPlan().toString()}" for n, df in found.items())
