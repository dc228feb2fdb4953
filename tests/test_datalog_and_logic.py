import pytest

from tessera.plans import datalog
from tessera.plans.logic import NotGrounded, Recursive, abs_, between, elem, exists, prefix, solve, syms
from tessera.sources.tables import browse


def got(df):
    return sorted(tuple(r) for r in df.collect())


def run(spark, text, **given):
    return {n: got(d) for n, d in datalog.execute(spark, text, given).items()}


CLOSURE = """
.decl edge(x:int, y:int)
.decl path(x:int, y:int)
edge(1, 2). edge(2, 3). edge(3, 1). // a cycle
path(X, Y) :- edge(X, Y).
path(X, Z) :- path(X, Y), path(Y, Z).
.output path
"""


def test_closure(spark):
    assert run(spark, CLOSURE)["path"] == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]


def test_negation_constants_and_arithmetic(spark):
    text = """
    .decl num(n:int)
    .decl odd(n:int)
    .decl even(n:int)
    .decl next(n:int, m:int)
    num(1). num(2). num(3). num(4).
    odd(1). odd(3).
    even(N) :- num(N), !odd(N).
    next(N, M) :- num(N), M = N + 1, M < 4.
    .output even
    .output next
    """
    assert run(spark, text) == {"even": [(2,), (4,)], "next": [(1, 2), (2, 3)]}


def test_repeated_variables_strings_and_underscore(spark):
    text = """
    .decl p(a:string, b:string)
    .decl same(a:string)
    .decl first(a:string)
    p("x", "x"). p("x", "y").
    same(A) :- p(A, A).
    first(A) :- p(A, _).
    .output same .output first
    """
    assert run(spark, text) == {"same": [("x",)], "first": [("x",)]}


@pytest.mark.parametrize(
    "text, message",
    [
        ("edge(1, 2).", "not declared"),
        (".decl e(x:int) e(1, 2).", "Atom e/2 does not match declaration e/1"),
        (".decl e(x:int) e(X).", "Argument in fact is not constant: X"),
        (".decl e(x:int) .decl f(x:int) f(X) :- e(Y).", "Variable 'X' in head does not appear in positive body atom"),
        (".decl e(x:int) .decl f(x:int) f(X) :- e(X), !f(X).", "not stratified"),
        ('.decl e(x:int) e("a").', "expected int, got string for parameter x"),
        (".decl e(x:int) .decl e(x:int)", "twice"),
    ],
)
def test_errors(text, message):
    assert message in datalog.validate(text)


@pytest.mark.parametrize(
    "text, told",
    [
        ("road(1, 2).", "Relation 'road' used in fact but not declared"),
        (".decl road(a:int, b:int) road(1).", "Atom road/1 does not match declaration road/2"),
        (".decl town(name:string) town(7).", "Type mismatch in fact town(...): expected string, got int for parameter name"),
        (".decl road(a:int, b:int) road(1, X).", "Argument in fact is not constant: X"),
        (".decl road(a:int, b:int) road(X, Y) :- road(X, _).", "Rule is unsafe. Variable 'Y' in head does not appear in positive body atom"),
        (".decl road(a:int, b:int) .decl odd(a:int) odd(X) :- road(X, _), !road(Z, X).", "Rule is unsafe. Variable 'Z' in negated atom does not appear in positive body atom"),
        (".decl e(x:int) .decl f(x:int) f(X) :- e(X), !f(X).", "Program is not stratified. Negation cycle detected involving relation: f"),
        (".decl e(x:int)\n.output f\n", "Relation 'f' used in .output but not declared"),
    ],
)
def test_what_is_said_of_invalid_programs(text, told):
    assert datalog.validate(text) == f"Compilation error: {told}"


def test_validate_and_input(spark, tmp_path):
    assert datalog.validate(CLOSURE) == "{path:{x:int, y:int} list}"
    (tmp_path / "edge.csv").write_text("y:int,x:int\n2,1\n3,2\n")
    found = datalog.execute(spark, ".decl edge(x:int, y:int) .input edge .output edge", folder=str(tmp_path))
    assert got(found["edge"]) == [(1, 2), (2, 3)]


def test_browse(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text("deptno:int,dname:string,ok:bool,pay:decimal\n10,'A, B',true,1.5\n\n20,'C',x\nNULL,'D',T,NULL\n")
    assert [tuple(r) for r in browse(spark, str(f)).collect()] == [(10, "'A", False, 0.0), (20, "C", False, 0.0), (0, "D", True, 0.0)]


def test_ranges_and_equations(spark):
    x, y = syms("x y")
    assert got(solve(["x", "y"], between(x, 1, 3) & (y == x + 10))) == [(1, 11), (2, 12), (3, 13)]
    assert got(solve(["x", "y"], between(x, 1, 3) & (x < y) & (y <= 3))) == [(1, 2), (1, 3), (2, 3)]
    assert got(solve(["x", "y"], (x + y == 5) & (x >= 1) & (y >= 3))) == [(1, 4), (2, 3)]
    assert got(solve(["x"], (2 * x + 3 <= 9) & (x >= 0))) == [(0,), (1,), (2,), (3,)]
    assert got(solve(["x"], (abs_(x) < 2))) == [(-1,), (0,), (1,)]


def test_membership_alternatives_and_extents(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "a int, b int")
    x, y, b = syms("x y b")
    assert got(solve(["x", "y"], elem((x, y), edges))) == [(1, 2), (2, 3)]
    assert got(solve(["x"], elem((x, 2), edges) | (x == 9))) == [(1,), (9,)]
    assert got(solve(["x"], exists(lambda z: elem((x, z), edges) & elem((z, 3), edges)))) == [(1,)]
    assert got(solve({"b": bool}, ~(b == False))) == [(True,)]  # noqa: E712
    assert got(solve({"x": [1, 2, 3]}, x != 2)) == [(1,), (3,)]
    (p,) = syms("p")
    assert got(solve(["p"], prefix(p, "ab"))) == [("",), ("a",), ("ab",)]


def test_recursive_predicate(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "x int, y int")
    path = Recursive(lambda path, x, y: elem((x, y), edges) | exists(lambda z: path(x, z) & elem((z, y), edges)))
    x, y = syms("x y")
    assert got(solve(["x", "y"], path(x, y))) == [(1, 2), (1, 3), (2, 3)]
    assert got(solve(["y"], path(1, y) & ~elem((1, y), edges))) == [(3,)]


def test_not_grounded(spark):
    x, y = syms("x y")
    with pytest.raises(NotGrounded, match="pattern 'x' is not grounded"):
        solve(["x"], abs_(x) > 5)
    with pytest.raises(NotGrounded):
        solve(["x", "y"], x * y == 100)
