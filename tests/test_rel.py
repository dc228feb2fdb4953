"""Steps over small collections: values, order, options and errors."""

import pytest

from pyspark.sql import functions as F

from tessera.operators import aggregates as agg
from tessera.operators.errors import PlacementError, RelError
from tessera.operators.fixpoint import iterate
from tessera.operators.rel import DESC, Rel, from_
from tessera.sources.tables import scott

EMPS = [(10, 100, "Fred"), (20, 101, "Velma"), (30, 102, "Shaggy"), (30, 103, "Scooby")]
DEPTS = [(10, "Sales"), (20, "HR"), (30, "Engineering"), (40, "Support")]


@pytest.fixture
def emps(spark):
    return Rel.literal(spark, EMPS, "deptno int, id int, name string", name="e")


@pytest.fixture
def depts(spark):
    return Rel.literal(spark, DEPTS, "deptno int, name string", name="d")


def rows(rel):
    return [tuple(r) if hasattr(r, "__fields__") else r for r in rel.collect()]


def ints(spark, *xs, ordered=True):
    return Rel.literal(spark, list(xs), "int", ordered, "x")


def test_a_list_keeps_its_order(emps):
    assert rows(emps.where(lambda e: e.deptno > 10).yield_(lambda e: e.name)) == ["Velma", "Shaggy", "Scooby"]


def test_joins_keep_nested_loop_order(emps, depts):
    got = rows(emps.join("d", depts, lambda e, d: e.deptno == d.deptno).yield_(lambda e, d: {"who": e.name, "where": d.name}))
    assert got == [("Sales", "Fred"), ("HR", "Velma"), ("Engineering", "Shaggy"), ("Engineering", "Scooby")]  # fields in label order


def test_right_join_appends_what_has_no_partner(spark):
    a, b = ints(spark, 3, 1), ints(spark, 5, 3, 1, 4)
    got = from_(a, "i").right_join("j", b, lambda i, j: i == j).yield_(lambda i, j: {"i": i, "j": j})
    assert rows(got) == [(3, 3), (1, 1), (None, 5), (None, 4)]


def test_full_join(spark):
    got = from_(ints(spark, 1, 2), "i").full_join("j", ints(spark, 2, 3), lambda i, j: i == j).yield_(lambda i, j: {"i": i, "j": j})
    assert rows(got) == [(1, None), (2, 2), (None, 3)]


def test_a_row_of_nulls_is_not_a_missing_row(spark, emps):
    some = Rel.literal(spark, [(10, None)], "k int, v string", name="r")
    got = emps.left_join("r", some, lambda e, r: e.deptno == r.k).yield_(lambda e, r: {"id": e.id, "some": r.is_some, "v": r.v})
    assert rows(got) == [(100, True, None), (101, False, None), (102, False, None), (103, False, None)]
    whole = emps.left_join("r", some, lambda e, r: e.deptno == r.k).yield_(lambda r: {"r": r.value}).where(lambda r: r.isNull() if hasattr(r, "isNull") else r.value.isNull())
    assert len(rows(whole)) == 3


def test_lateral_scan_and_left_lateral(spark):
    orders = Rel.literal(spark, [(1, ["a", "b"]), (2, [])], "id int, items array<string>", name="o")
    assert rows(orders.scan("i", lambda o: o.items).yield_(lambda o, i: {"id": o.id, "item": i})) == [(1, "a"), (1, "b")]
    left = orders.left_join("i", lambda o: o.items).yield_(lambda o, i: {"id": o.id, "item": i})
    assert rows(left) == [(1, "a"), (1, "b"), (2, None)]
    filtered = orders.left_join("i", lambda o: o.items, lambda i: i == "b").yield_(lambda o, i: {"id": o.id, "item": i})
    assert rows(filtered) == [(1, "b"), (2, None)]
    assert rows(orders.yield_all(lambda o: o.items)) == ["a", "b"]


def test_order_composite_desc_and_stable(spark, emps):
    assert rows(emps.order(lambda e: (DESC(e.deptno), e.name)).yield_(lambda e: e.name)) == ["Scooby", "Shaggy", "Velma", "Fred"]
    assert rows(emps.order(lambda e: DESC(e.deptno)).yield_(lambda e: e.name)) == ["Shaggy", "Scooby", "Velma", "Fred"]
    by_record = emps.order(lambda e: {"b": e.name, "a": e.deptno}).yield_(lambda e: e.id)  # label order: a first
    assert rows(by_record) == [100, 101, 103, 102]
    options = Rel.literal(spark, [3, None, 1], "int", name="x")
    assert rows(options.order(lambda x: x)) == [None, 1, 3]
    assert rows(options.order(lambda x: DESC(x))) == [3, 1, None]


def test_skip_take_clamp(spark):
    x = ints(spark, 5, 4, 3, 2, 1)
    assert rows(x.skip(1).take(2)) == [4, 3]
    assert rows(x.take(-1)) == [] and rows(x.skip(-3)) == [5, 4, 3, 2, 1]


def test_ordinal(spark, emps):
    got = emps.order(lambda e: e.name).ordinal().yield_(lambda e, ordinal: {"name": e.name, "n": ordinal})
    assert sorted(rows(got)) == [(0, "Fred"), (1, "Scooby"), (2, "Shaggy"), (3, "Velma")]
    with pytest.raises(PlacementError):
        emps.unorder().ordinal()


def test_orderedness(spark, emps):
    bag = Rel.literal(spark, [1, 2], "int", False, "b")
    assert emps.where(lambda e: e.id > 0).ordered and not emps.unorder().ordered
    assert not emps.scan("b", bag).ordered and emps.unorder().order(lambda e: e.id).ordered
    assert not emps.yield_(lambda e: e.id).union(bag).ordered


def test_group_in_order_of_first_appearance(emps):
    got = emps.order(lambda e: DESC(e.id)).group(["e.deptno"], {"n": lambda: agg.count(), "ids": lambda e: F.sort_array(F.collect_list(e.id))})
    assert rows(got.yield_(lambda deptno, n: {"deptno": deptno, "n": n})) == [(30, 2), (20, 1), (10, 1)]


def test_group_without_keys_and_empty_input(spark, emps):
    none = emps.where(lambda e: e.id < 0)
    assert rows(none.group(None, {"n": lambda: agg.count(), "s": lambda e: agg.sum_(e.id)})) == [(0, 0)]
    assert len(rows(none.group())) == 1
    with pytest.raises(Exception, match="Empty"):
        none.compute({"m": lambda e: agg.max_(e.id)}).collect()
    assert none.group(["e.deptno"], {"n": lambda: agg.count()}).collect() == []
    options = Rel.literal(spark, [1, None, 3], "int", False, "x")
    assert rows(options.compute({"hi": lambda x: agg.max_(x), "lo": lambda x: agg.min_(x), "n": lambda: agg.count()})) == [(3, None, 3)]


def test_elements_and_user_aggregate(emps):
    got = emps.group(["e.deptno"], {"names": lambda elements: F.transform(elements, lambda r: r["name"])})
    assert rows(got) == [(10, ["Fred"]), (20, ["Velma"]), (30, ["Shaggy", "Scooby"])]
    joined = emps.group(["e.deptno"], {"all": lambda e: agg.over(lambda a: F.array_join(a, "+"), e.name, sort=True)})
    assert ("Scooby+Shaggy", 30) in rows(joined)


def test_only(spark):
    assert ints(spark, 7).only() == 7
    with pytest.raises(RelError, match="Empty"):
        ints(spark).only()
    with pytest.raises(RelError, match="Size"):
        ints(spark, 1, 2).only()


def test_multiset_operations_on_lists(spark):
    a, b = ints(spark, 2, 1, 2, 2, 2, 3), ints(spark, 2, 2, 4)
    assert rows(a.union(b)) == [2, 1, 2, 2, 2, 3, 2, 2, 4]
    assert rows(a.union(b, distinct=True)) == [2, 1, 3, 4]
    assert rows(a.intersect(b)) == [2, 2]
    assert rows(a.except_(b)) == [1, 2, 2, 3]
    assert rows(a.intersect(b, distinct=True)) == [2] and rows(a.except_(b, distinct=True)) == [1, 3]
    assert sorted(rows(a.unorder().except_(b))) == [1, 2, 2, 3]
    assert rows(a.intersect(b, ints(spark, 2))) == [2]


def test_distinct_keeps_first_places(spark):
    assert rows(ints(spark, 3, 1, 3, 2, 1).distinct()) == [3, 1, 2]
    assert len(rows(from_(spark=spark).distinct())) == 1


def test_elem_sees_missing_values_as_equal(spark):
    a, b = Rel.literal(spark, [1, None, 2], "int", name="a"), Rel.literal(spark, [None, 2], "int", name="b")
    assert rows(a.elem(lambda a: a, b)) == [None, 2]
    assert rows(a.notelem(lambda a: a, b)) == [1]


def test_through_into_exists_forall(spark, emps):
    assert rows(emps.through("r", lambda rel: rel.group(["e.deptno"], {"n": lambda: agg.count()})).where(lambda r: r.n > 1)) == [(30, 2)]
    assert emps.into(lambda rel: rel.df.count()) == 4
    assert emps.where(lambda e: e.id == 101).exists() and emps.forall(lambda e: e.id >= 100)
    assert emps.where(lambda e: e.id < 0).forall(lambda e: e.id == 1)


def test_match_and_range(spark, emps):
    assert rows(emps.match("e", {"deptno": 30}, {"who": "name"}).yield_(lambda who: who)) == ["Shaggy", "Scooby"]
    assert rows(Rel.range(spark, 3, 5, "i")) == [3, 4, 5] and rows(Rel.range(spark, 3, 2, "i")) == []


def test_dependent_take(emps):
    got = emps.take_by(lambda e: e.deptno, 1, lambda e: DESC(e.id)).yield_(lambda e: e.id)
    assert sorted(rows(got)) == [100, 101, 103]


def test_unknown_variable_and_field(emps):
    with pytest.raises(RelError, match="unbound variable 'z'"):
        emps.where(lambda z: z)
    with pytest.raises(AttributeError):
        emps.where(lambda e: e.salary > 1)


def test_iterate(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "x int, y int")
    hop = edges.toDF("y", "z")
    closure = iterate(edges, lambda total, new: new.join(hop, "y").select("x", "z"))
    assert closure.count() == 9
    repeated = spark.createDataFrame([(1,), (1,)], "x int")
    assert iterate(repeated, lambda total, new: new).count() == 2


def test_scott(spark):
    db = scott(spark)
    graded = db["emps"].join("g", db["salgrades"], lambda emp, g: (emp.sal >= g.losal) & (emp.sal <= g.hisal)).group(["g.grade"], {"n": lambda: agg.count()})
    assert sorted(rows(graded)) == [(1, 3), (2, 3), (3, 2), (4, 5), (5, 1)]
    right = db["emps"].right_join("d", db["depts"], lambda emp, d: emp.deptno == d.deptno).where(lambda emp: emp.is_none).yield_(lambda d: d.dname)
    assert rows(right) == ["OPERATIONS"]
    assert rows(db["bonuses"]) == []
