"""Registry of the library's own queries: name -> (spark, sf_dir) -> DataFrame, and the same as SQL.

Every query runs over its whole tables. Integers are bigint and sums of doubles are rounded, so that two engines
can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.collections import Bag, Either, List, ListPair, Option, Vector
from tessera.functions.numbers import Bool, Int, Math, Real, Word
from tessera.functions.ranges import Range, RangeSet
from tessera.functions.records import extend, remove, rename, with_
from tessera.functions.strings import Char, String, StringCvt
from tessera.functions.times import Date, Time
from tessera.operators import aggregates as agg
from tessera.operators.fixpoint import iterate
from tessera.operators.rel import DESC, Rel, from_
from tessera.plans import datalog
from tessera.plans.lang import Session
from tessera.plans.logic import Recursive, abs_, between, elem, exists, mod, prefix, solve, syms
from tessera.plans.registry import ORACLES, QUERIES, query
from tessera.sources.tables import parquet, table

FLAGSHIP = "q_group_compute"


def big(c):
    return c.cast("bigint")


def flag(c):
    return c.cast("bigint")


def cents(c):
    return F.round(c, 2)


# ---------------------------------------------------------------- scan, filter, project


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n, round(sum(l_discount) / count(*), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q_group_compute(spark: SparkSession, d: str) -> DataFrame:
    """where, group and compute over lineitem."""
    return (
        table(spark, d, "lineitem", "l")
        .where(lambda l: l.l_shipdate <= F.lit("1998-09-02").cast("timestamp"))
        .group(
            ["l.l_returnflag", "l.l_linestatus"],
            {
                "sum_qty": lambda l: big(agg.sum_(l.l_quantity)),
                "sum_price": lambda l: cents(agg.sum_(l.l_extendedprice)),
                "sum_disc": lambda l: cents(agg.sum_(l.l_extendedprice * (1 - l.l_discount))),
                "n": lambda: agg.count(),
                "avg_disc": lambda l: F.round(agg.sum_(l.l_discount) / agg.count(), 6),
            },
        )
        .order(lambda l_returnflag, l_linestatus: (l_returnflag, l_linestatus))
        .result()
    )


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def q_scan_yield(spark, d):
    return from_(table(spark, d, "customer"), "c").yield_(lambda c: {"id": c.c_custkey, "name": c.c_name}).result()


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 AND s_nationkey <> 3")
def q_where(spark, d):
    return table(spark, d, "supplier", "s").where(lambda s: (s.s_acctbal > 5000) & (s.s_nationkey != 3)).result()


@query("SELECT p_partkey FROM part WHERE NOT (p_size > 20) OR p_retailprice > 1200")
def q_where_implies(spark, d):
    return table(spark, d, "part", "p").where(lambda p: Bool.implies(p.p_size > 20, p.p_retailprice > 1200)).yield_(lambda p: {"p_partkey": p.p_partkey}).result()


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def q_case(spark, d):
    return table(spark, d, "orders", "o").yield_(lambda o: {"o_orderkey": o.o_orderkey, "band": F.when(o.o_totalprice > 200000, "high").when(o.o_totalprice > 100000, "mid").otherwise("low")}).result()


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 300000")
def q_scalar_scan(spark, d):
    """A variable bound to one value for each row."""
    return table(spark, d, "orders", "o").let("twice", lambda o: o.o_totalprice * 2).where(lambda twice: twice > 300000).yield_(lambda o, twice: {"o_orderkey": o.o_orderkey, "twice": twice}).result()


@query("SELECT r_regionkey, r_name FROM (SELECT r_regionkey, r_name FROM region) WHERE r_regionkey < 3")
def q_yield_binder(spark, d):
    return table(spark, d, "region", "x").yield_(lambda x: x, name="r").where(lambda r: r.r_regionkey < 3).result()


@query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer")
def q_record_update(spark, d):
    return table(spark, d, "customer", "c").yield_(lambda c: with_(remove(c, "c_name", "c_nationkey"), c_acctbal=c.c_acctbal + 1)).result()


@query("SELECT n_nationkey AS id, n_name, n_regionkey, n_nationkey * 10 AS tens FROM nation")
def q_record_modifiers(spark, d):
    return table(spark, d, "nation", "n").yield_(lambda n: extend(rename(n, n_nationkey="id"), tens=n.n_nationkey * 10)).result()


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def q_pattern_scan(spark, d):
    return table(spark, d, "nation", "n").match("n", {"n_regionkey": 2}, {"name": "n_name"}).yield_(lambda name: {"n_name": name}).result()


# ---------------------------------------------------------------- joins


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
def q_comma_join(spark, d):
    return table(spark, d, "region", "r").scan("n", table(spark, d, "nation")).where(lambda r, n: r.r_regionkey != n.n_regionkey).yield_(lambda r, n: {"r_name": r.r_name, "n_name": n.n_name}).result()


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_join_equi(spark, d):
    return (
        table(spark, d, "orders", "o")
        .join("c", table(spark, d, "customer"), lambda o, c: o.o_custkey == c.c_custkey)
        .where(lambda c: c.c_mktsegment == "BUILDING")
        .yield_(lambda o, c: {"o_orderkey": o.o_orderkey, "c_name": c.c_name, "o_totalprice": o.o_totalprice})
        .result()
    )


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 8000")
def q_join_theta(spark, d):
    return table(spark, d, "supplier", "s").join("n", table(spark, d, "nation"), lambda s, n: (s.s_nationkey < n.n_nationkey) & (s.s_acctbal > 8000)).yield_(lambda s, n: {"s_suppkey": s.s_suppkey, "n_nationkey": n.n_nationkey}).result()


@query("SELECT o_orderkey, CAST(l_orderkey IS NOT NULL AS BIGINT) AS has_line, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
def q_left_join(spark, d):
    return (
        table(spark, d, "orders", "o")
        .left_join("l", table(spark, d, "lineitem"), lambda o, l: (o.o_orderkey == l.l_orderkey) & (l.l_quantity > 45))
        .yield_(lambda o, l: {"o_orderkey": o.o_orderkey, "has_line": flag(l.is_some), "l_linenumber": l.l_linenumber})
        .result()
    )


@query("SELECT n_name, s_suppkey, CAST(s_suppkey IS NULL AS BIGINT) AS missing FROM (SELECT * FROM supplier WHERE s_acctbal > 6000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def q_right_join(spark, d):
    return (
        table(spark, d, "supplier", "s")
        .where(lambda s: s.s_acctbal > 6000)
        .right_join("n", table(spark, d, "nation"), lambda s, n: s.s_nationkey == n.n_nationkey)
        .yield_(lambda s, n: {"n_name": n.n_name, "s_suppkey": s.s_suppkey, "missing": flag(s.is_none)})
        .result()
    )


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON s_suppkey = c_custkey")
def q_full_join(spark, d):
    return (
        table(spark, d, "supplier", "s")
        .where(lambda s: s.s_acctbal > 0)
        .full_join("c", table(spark, d, "customer", "x").where(lambda x: x.c_acctbal < 0), lambda s, c: s.s_suppkey == c.c_custkey)
        .yield_(lambda s, c: {"s_suppkey": s.s_suppkey, "c_custkey": c.c_custkey})
        .result()
    )


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q_four_way_join(spark, d):
    return (
        table(spark, d, "customer", "c")
        .join("o", table(spark, d, "orders"), lambda c, o: c.c_custkey == o.o_custkey)
        .join("l", table(spark, d, "lineitem"), lambda o, l: o.o_orderkey == l.l_orderkey)
        .join("n", table(spark, d, "nation"), lambda c, n: c.c_nationkey == n.n_nationkey)
        .group(["n.n_name"], {"n": lambda: agg.count(), "revenue": lambda l: cents(agg.sum_(l.l_extendedprice * (1 - l.l_discount)))})
        .result()
    )


def purchases(spark, d) -> DataFrame:
    """An edge from each user to each event of a purchase."""
    e = parquet(spark, d, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("x"), F.col("event_id").alias("y")).where("x <> y").distinct()


EDGES = "SELECT DISTINCT user_id AS x, event_id AS y FROM events WHERE event_type = 'purchase' AND user_id <> event_id"


SUPPLIES = "SELECT DISTINCT l_partkey AS x, l_suppkey AS y FROM lineitem WHERE l_partkey <> l_suppkey"


@query(f"WITH e AS ({SUPPLIES}) SELECT a.x AS a, b.x AS b, c.x AS c FROM e a, e b, e c WHERE a.y = b.x AND b.y = c.x AND c.y = a.x AND a.x < b.x AND a.x < c.x")
def q_triangles(spark, d):
    """Cycles of three keys, an edge leading from each part to its suppliers' keys."""
    return triangles(parquet(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).where("x <> y").distinct())


def triangles(edges: DataFrame) -> DataFrame:
    e = Rel.bag(edges)
    return (
        from_(e, "p")
        .join("q", e, lambda p, q: (p.y == q.x) & (p.x < q.x))
        .join("r", e, lambda p, q, r: (q.y == r.x) & (r.y == p.x) & (p.x < r.x))
        .yield_(lambda p, q, r: {"a": p.x, "b": q.x, "c": r.x})
        .result()
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_semi_elem(spark, d):
    big_ones = table(spark, d, "orders", "o").where(lambda o: o.o_totalprice > 300000).yield_(lambda o: o.o_custkey)
    return table(spark, d, "customer", "c").elem(lambda c: c.c_custkey, big_ones).yield_(lambda c: {"c_custkey": c.c_custkey}).result()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_anti_notelem(spark, d):
    big_ones = table(spark, d, "orders", "o").where(lambda o: o.o_totalprice > 300000).yield_(lambda o: o.o_custkey)
    return table(spark, d, "customer", "c").notelem(lambda c: c.c_custkey, big_ones).yield_(lambda c: {"c_custkey": c.c_custkey}).result()


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50 AND l_discount > 0.05)")
def q_exists_correlated(spark, d):
    return table(spark, d, "part", "p").semi("l", table(spark, d, "lineitem"), lambda p, l: (l.l_partkey == p.p_partkey) & (l.l_quantity == 50) & (l.l_discount > 0.05)).yield_(lambda p: {"p_partkey": p.p_partkey}).result()


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity < 40))")
def q_forall_correlated(spark, d):
    return table(spark, d, "orders", "o").anti("l", table(spark, d, "lineitem"), lambda o, l: (l.l_orderkey == o.o_orderkey) & ~(l.l_quantity < 40)).yield_(lambda o: {"o_orderkey": o.o_orderkey}).result()


@query("SELECT CAST(EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS BIGINT) AS any_negative, CAST(NOT EXISTS (SELECT 1 FROM lineitem WHERE NOT (l_quantity > 0)) AS BIGINT) AS all_positive")
def q_exists_forall(spark, d):
    negative = table(spark, d, "orders", "o").where(lambda o: o.o_totalprice < 0).group({}, {"n": lambda: agg.non_empty()}).result()
    others = table(spark, d, "lineitem", "l").where(lambda l: ~(l.l_quantity > 0)).group({}, {"n": lambda: agg.empty()}).result()
    both = negative.select(flag(F.col("n")).alias("v"), F.lit("e").alias("k")).unionByName(others.select(flag(F.col("n")).alias("v"), F.lit("a").alias("k")))
    return both.agg(F.max(F.when(F.col("k") == "e", F.col("v"))).alias("any_negative"), F.max(F.when(F.col("k") == "a", F.col("v"))).alias("all_positive"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def q_lateral_top_k(spark, d):
    return table(spark, d, "orders", "o").take_by(lambda o: o.o_custkey, 3, lambda o: (DESC(o.o_totalprice), o.o_orderkey)).yield_(lambda o: {"o_custkey": o.o_custkey, "o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).result()


@query("SELECT n_name, c_custkey FROM (SELECT n_name, c_custkey, n_regionkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal, c_custkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE k <= n_regionkey + 1")
def q_lateral_take_outer(spark, d):
    """The number of rows taken depends on the outer row."""
    return (
        table(spark, d, "nation", "n")
        .join("c", table(spark, d, "customer"), lambda n, c: n.n_nationkey == c.c_nationkey)
        .take_by(lambda n: n.n_nationkey, lambda n: n.n_regionkey + 1, lambda c: (c.c_acctbal, c.c_custkey))
        .yield_(lambda n, c: {"n_name": n.n_name, "c_custkey": c.c_custkey})
        .result()
    )


@query("SELECT n_name, c_mktsegment, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
def q_lateral_group(spark, d):
    return table(spark, d, "nation", "n").join("c", table(spark, d, "customer"), lambda n, c: n.n_nationkey == c.c_nationkey).group(["n.n_name", "c.c_mktsegment"], {"n": lambda: agg.count()}).result()


@query("SELECT vec_id, CAST(i AS BIGINT) AS place, round(CAST(x AS DOUBLE), 4) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) WHERE x > 0.2")
def q_lateral_explode(spark, d):
    """A scan of a collection that each row holds."""
    return (
        table(spark, d, "embeddings", "e")
        .scan("p", lambda e: Vector.indexed(e.embedding))
        .where(lambda p: p._2 > 0.2)
        .yield_(lambda e, p: {"vec_id": e.vec_id, "place": big(p._1), "x": F.round(p._2.cast("double"), 4)})
        .result()
    )


# ---------------------------------------------------------------- aggregation


@query("SELECT c_mktsegment, CAST(floor(c_acctbal / 1000) AS BIGINT) AS k, count(*) AS n, round(min(c_acctbal), 2) AS lo, round(max(c_acctbal), 2) AS hi FROM customer GROUP BY ALL")
def q_group_expression(spark, d):
    return (
        table(spark, d, "customer", "c")
        .group({"c_mktsegment": lambda c: c.c_mktsegment, "k": lambda c: F.floor(c.c_acctbal / 1000)}, {"n": lambda: agg.count(), "lo": lambda c: cents(agg.min_(c.c_acctbal)), "hi": lambda c: cents(agg.max_(c.c_acctbal))})
        .result()
    )


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0")
def q_group_nothing(spark, d):
    """group without keys: one row even of no rows; the sum of nothing is zero."""
    return table(spark, d, "lineitem", "l").where(lambda l: l.l_quantity < 0).group(None, {"n": lambda: agg.count(), "total": lambda l: big(agg.sum_(l.l_quantity))}).result()


ORACLES["q_group_nothing"] = "SELECT count(*) AS n, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0"


@query("SELECT count(*) AS n, round(max(o_totalprice), 2) AS top, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders")
def q_compute(spark, d):
    return table(spark, d, "orders", "o").compute({"n": lambda: agg.count(), "top": lambda o: cents(agg.max_(o.o_totalprice)), "customers": lambda o: agg.count_distinct(o.o_custkey)}).result()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def q_scalar_subquery(spark, d):
    top = table(spark, d, "orders", "x").compute({"top": lambda x: agg.max_(x.o_totalprice)}).yield_(lambda top: top, name="t")
    return table(spark, d, "orders", "o").join("t", top, lambda o, t: o.o_totalprice == t).yield_(lambda o: {"o_orderkey": o.o_orderkey}).result()


@query("SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def q_group_elements(spark, d):
    """elements: a group's rows as a list in the input's order."""
    ordered = table(spark, d, "orders", "o").order(lambda o: o.o_orderkey)
    return ordered.group(["o.o_custkey"], {"rows": lambda elements: elements}).yield_(lambda o_custkey, rows: {"o_custkey": o_custkey, "orders": F.array_join(F.transform(rows, lambda r: r["o_orderkey"].cast("string")), ",")}).result()


@query("SELECT p_brand, CAST(list_sum(list_transform(list(p_size), lambda x: x * x)) AS BIGINT) AS squares, CAST(len(list_filter(list(p_size), lambda x: x > 25)) AS BIGINT) AS large FROM part GROUP BY p_brand")
def q_user_aggregate(spark, d):
    """Any function of a collection as an aggregate."""
    squares = lambda a: List.foldl(lambda x, n: n + (x * x).cast("bigint"), F.lit(0).cast("bigint"), a)
    return table(spark, d, "part", "p").group(["p.p_brand"], {"squares": lambda p: agg.over(squares, p.p_size), "large": lambda p: big(F.size(agg.over(lambda a: F.filter(a, lambda x: x > 25), p.p_size)))}).result()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_distinct(spark, d):
    return table(spark, d, "orders", "o").yield_(lambda o: {"o_orderstatus": o.o_orderstatus, "o_orderpriority": o.o_orderpriority}).distinct().result()


@query("SELECT l_returnflag FROM lineitem GROUP BY l_returnflag")
def q_group_keys_only(spark, d):
    return table(spark, d, "lineitem", "l").group(["l.l_returnflag"]).result()


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def q_group_of_group(spark, d):
    return table(spark, d, "orders", "o").group(["o.o_custkey"], {"n": lambda: agg.count()}).group(["n"], {"customers": lambda: agg.count()}).result()


# ---------------------------------------------------------------- order, limit, set operations, tables functions


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_order_take(spark, d):
    return table(spark, d, "orders", "o").order(lambda o: (DESC(o.o_totalprice), o.o_orderkey)).take(10).yield_(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).result()


@query("SELECT p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 20 OFFSET 15")
def q_skip_take(spark, d):
    return table(spark, d, "part", "p").order(lambda p: (p.p_brand, DESC(p.p_size), p.p_partkey)).skip(15).take(20).yield_(lambda p: {"p_partkey": p.p_partkey}).result()


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS BIGINT) AS place FROM customer")
def q_ordinal(spark, d):
    return table(spark, d, "customer", "c").order(lambda c: (DESC(c.c_acctbal), c.c_custkey)).ordinal("place").yield_(lambda c, place: {"c_custkey": c.c_custkey, "place": place}).result()


@query("SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS k FROM supplier) WHERE k % 10 = 3")
def q_ordinal_filter(spark, d):
    return table(spark, d, "supplier", "s").order(lambda s: (s.s_name, s.s_suppkey)).ordinal().where(lambda ordinal: ordinal % 10 == 3).yield_(lambda s: {"s_suppkey": s.s_suppkey}).result()


SETS = "(SELECT o_custkey AS k FROM orders)", "(SELECT l_suppkey AS k FROM lineitem)", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')"


def key_sets(spark, d) -> list[Rel]:
    finished = table(spark, d, "orders", "o").where(lambda o: o.o_orderstatus == "F")
    return [table(spark, d, "orders", "o").yield_(lambda o: {"k": o.o_custkey}), table(spark, d, "lineitem", "l").yield_(lambda l: {"k": l.l_suppkey}), finished.yield_(lambda o: {"k": o.o_custkey})]


for _name, _method, _distinct, _op in (
    ("union_all", "union", False, "UNION ALL"),
    ("union_distinct", "union", True, "UNION"),
    ("intersect_all", "intersect", False, "INTERSECT ALL"),
    ("intersect_distinct", "intersect", True, "INTERSECT"),
    ("except_all", "except_", False, "EXCEPT ALL"),
    ("except_distinct", "except_", True, "EXCEPT"),
):

    def _set_query(spark, d, method=_method, distinct=_distinct):
        a, *rest = key_sets(spark, d)
        return getattr(a, method)(*rest, distinct=distinct).result()

    QUERIES[f"q_{_name}"] = _set_query
    ORACLES[f"q_{_name}"] = f"SELECT * FROM ({SETS[0]} {_op} {SETS[1]}) {_op} {SETS[2]}"


@query("SELECT CAST(c_custkey AS BIGINT) AS k FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT s_suppkey FROM supplier)")
def q_ordered_except(spark, d):
    """Of a list the earliest go; the rest keeps its order."""
    return without_suppliers(spark, d, table(spark, d, "customer", "c"))


def without_suppliers(spark, d, customers: Rel) -> DataFrame:
    mine = customers.order(lambda c: c.c_custkey).yield_(lambda c: {"k": c.c_custkey})
    return mine.except_(table(spark, d, "supplier", "s").yield_(lambda s: {"k": s.s_suppkey})).result()


@query("SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(lang || '-' || source, '-')) AS word FROM documents)")
def q_yield_all(spark, d):
    return table(spark, d, "documents", "x").scan("w", lambda x: F.split(F.concat_ws("-", x.lang, x.source), "-")).yield_(lambda x, w: {"doc_id": x.doc_id, "word": w}).result()


@query("SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM orders GROUP BY o_orderpriority")
def q_through_pivot(spark, d):
    """A table function: the whole collection in, another out."""

    def pivot(rel: Rel) -> Rel:
        count = lambda s: lambda x: F.sum((x.o_orderstatus == s).cast("bigint"))
        return rel.group(["x.o_orderpriority"], {"f": count("F"), "o": count("O"), "p": count("P")})

    return table(spark, d, "orders", "x").through("r", pivot).result()


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size > 10")
def q_into(spark, d):
    return table(spark, d, "part", "p").where(lambda p: p.p_size > 10).into(lambda rel: rel.compute({"n": lambda: agg.count()})).result()


# ---------------------------------------------------------------- recursion, Datalog, unbounded variables


@query(f"WITH RECURSIVE e AS ({EDGES}), t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x) SELECT x, y FROM t")
def q_iterate_closure(spark, d):
    return closure(purchases(spark, d))


def closure(e: DataFrame) -> DataFrame:
    hop = e.toDF("y", "z")
    return iterate(e, lambda total, new: new.join(hop, "y").select("x", F.col("z").alias("y")))


@query(f"WITH RECURSIVE e AS ({EDGES}), t(y, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.y, t.hops + 1 FROM t JOIN e ON t.y = e.x WHERE t.hops < 4) SELECT y, CAST(min(hops) AS BIGINT) AS hops FROM t GROUP BY y")
def q_iterate_hops(spark, d):
    return hops(spark, purchases(spark, d))


def hops(spark, e: DataFrame) -> DataFrame:
    seed = spark.createDataFrame([(0, 0)], "y bigint, hops bigint")
    reached = iterate(seed, lambda total, new: new.where("hops < 4").join(e.toDF("y", "z"), "y").groupBy("z").agg(F.min(F.col("hops") + 1)).toDF("y", "hops").join(total.select("y"), "y", "left_anti"))
    return Rel.bag(reached, "r").group(["r.y"], {"hops": lambda r: agg.min_(r.hops)}).result()


PATHS = f"WITH RECURSIVE e AS ({EDGES}), t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x)"


def pairs(relations: dict, name: str) -> DataFrame:
    return relations[name].select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))


@query(f"{PATHS} SELECT x, y FROM t")
def q_datalog_closure(spark, d):
    program = """
        .decl edge(x:int, y:int)
        .decl path(x:int, y:int)
        path(X, Y) :- edge(X, Y).
        path(X, Z) :- path(X, Y), path(Y, Z).
        .output path
    """
    return pairs(datalog.execute(spark, program, {"edge": purchases(spark, d)}), "path")


@query(f"{PATHS} SELECT x, y FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.x = t.x AND e.y = t.y) AND NOT EXISTS (SELECT 1 FROM t u WHERE u.x = t.y AND u.y = t.x)")
def q_datalog_negation(spark, d):
    """Paths of several edges without a way back: a stratum that negates a recursive one."""
    program = """
        .decl edge(x:int, y:int)
        .decl path(x:int, y:int)
        .decl oneway(x:int, y:int)
        path(X, Y) :- edge(X, Y).
        path(X, Z) :- path(X, Y), edge(Y, Z).
        oneway(X, Y) :- path(X, Y), !edge(X, Y), !path(Y, X).
        .output oneway
    """
    return pairs(datalog.execute(spark, program, {"edge": purchases(spark, d)}), "oneway")


@query("SELECT DISTINCT n_name AS nation, r_name AS region, CAST(n_nationkey * 2 + 1 AS BIGINT) AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def q_datalog_join(spark, d):
    program = """
        .decl nation(k:int, name:string, r:int)
        .decl region(k:int, name:string)
        .decl named(nation:string, region:string, code:int)
        named(N, R, C) :- nation(K, N, Q), region(Q, R), R != "ASIA", C = K * 2 + 1.
        .output named
    """
    found = datalog.execute(spark, program, {"nation": parquet(spark, d, "nation"), "region": parquet(spark, d, "region")})["named"]
    return found.withColumn("code", F.col("code").cast("bigint"))


@query(f"WITH RECURSIVE e AS ({EDGES}), odd(x, y, p) AS (SELECT x, y, 1 FROM e UNION SELECT o.x, e.y, 1 - o.p FROM odd o JOIN e ON o.y = e.x) SELECT x, y FROM odd WHERE p = 0")
def q_datalog_mutual(spark, d):
    """Two relations that need each other: paths of an odd and of an even length."""
    program = """
        .decl e(x:int, y:int)
        .decl odd(x:int, y:int)
        .decl even(x:int, y:int)
        odd(X, Y) :- e(X, Y).
        odd(X, Z) :- even(X, Y), e(Y, Z).
        even(X, Z) :- odd(X, Y), e(Y, Z).
        .output even
    """
    return pairs(datalog.execute(spark, program, {"e": purchases(spark, d)}), "even")


@query("SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM range(1, 40) a(x), range(1, 40) b(y) WHERE x + y = 40 AND x < y")
def q_unbounded_range(spark, d):
    x, y = syms("x y")
    found = solve(["x", "y"], (x > 0) & (x < 40) & (x + y == 40) & (x < y))
    return found.select(*(F.col(c).cast("bigint").alias(c) for c in found.columns))


@query("SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM range(-60, 61) a(x), range(-60, 61) b(y) WHERE 3 * x + 2 * y <= 30 AND x >= 2 AND y >= 1 AND abs(x - y) <= 4")
def q_unbounded_fbbt(spark, d):
    """Neither variable has an upper bound of its own: propagation finds one."""
    x, y = syms("x y")
    found = solve(["x", "y"], (3 * x + 2 * y <= 30) & (x >= 2) & (y >= 1) & (abs_(x - y) <= 4))
    return found.select(*(F.col(c).cast("bigint").alias(c) for c in found.columns))


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT a.x AS x, b.y AS z FROM e a JOIN e b ON a.y = b.x WHERE a.x < b.y")
def q_unbounded_elem(spark, d):
    return two_steps(purchases(spark, d))


def two_steps(e: DataFrame) -> DataFrame:
    x, z = syms("x z")
    return solve(["x", "z"], exists(lambda y: elem((x, y), e) & elem((y, z), e)) & (x < z))


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT k FROM (SELECT x AS k FROM e WHERE y = 7 UNION SELECT y FROM e WHERE x = 3 UNION SELECT CAST(99 AS BIGINT))")
def q_unbounded_orelse(spark, d):
    return either_end(purchases(spark, d))


def either_end(e: DataFrame) -> DataFrame:
    (k,) = syms("k")
    return solve(["k"], elem((k, 7), e) | elem((3, k), e) | (k == 99)).select(F.col("k").cast("bigint").alias("k"))


@query(f"{PATHS} SELECT x, y FROM t")
def q_unbounded_closure(spark, d):
    x, y = syms("x y")
    return solve(["x", "y"], path_of(purchases(spark, d))(x, y))


def path_of(e: DataFrame) -> Recursive:
    return Recursive(lambda path, x, y: elem((x, y), e) | exists(lambda z: path(x, z) & elem((z, y), e)))


@query("SELECT DISTINCT left(r_name, CAST(i AS INT)) AS p FROM region, range(0, 30) t(i) WHERE i <= length(r_name) AND i >= 1")
def q_unbounded_prefix(spark, d):
    names = parquet(spark, d, "region").select("r_name")
    (p,) = syms("p")
    return solve(["p"], exists(lambda s: elem(s, names) & prefix(p, s)) & (p != ""))


@query("SELECT CAST(x AS BIGINT) AS x FROM range(0, 30) t(x) WHERE x % 7 = 3 OR x = 5")
def q_unbounded_mod(spark, d):
    (x,) = syms("x")
    return solve(["x"], between(x, 0, 29) & ((mod(x, 7) == 3) | (x == 5))).select(F.col("x").cast("bigint").alias("x"))


# ---------------------------------------------------------------- the library


@query("SELECT o_orderkey, CAST(floor((o_custkey - 700) / 7.0) AS BIGINT) AS d, CAST((o_custkey - 700) - 7 * floor((o_custkey - 700) / 7.0) AS BIGINT) AS m, CAST(trunc((o_custkey - 700) / 7.0) AS BIGINT) AS q, CAST((o_custkey - 700) % 7 AS BIGINT) AS r FROM orders")
def q_int_division(spark, d):
    k = lambda o: o.o_custkey - 700
    return table(spark, d, "orders", "o").yield_(lambda o: {"o_orderkey": o.o_orderkey, "d": big(Int.div(k(o), 7)), "m": big(Int.mod(k(o), 7)), "q": big(Int.quot(k(o), 7)), "r": big(Int.rem(k(o), 7))}).result()


@query("SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(trunc(c_acctbal) AS BIGINT) AS t, CAST(sign(c_acctbal) AS BIGINT) AS s FROM customer")
def q_real_rounding(spark, d):
    wide = lambda c: c.c_acctbal
    return table(spark, d, "customer", "c").yield_(lambda c: {"c_custkey": c.c_custkey, "f": big(Real.floor(wide(c))), "c": big(Real.ceil(wide(c))), "t": big(Real.trunc(wide(c))), "s": big(Real.sign(wide(c)))}).result()


@query("SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS n, left(p_name, 3) AS head, replace(p_name, ' ', '') AS joined, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS BIGINT) AS words FROM part")
def q_string_functions(spark, d):
    return (
        table(spark, d, "part", "p")
        .yield_(
            lambda p: {
                "p_partkey": p.p_partkey,
                "up": String.map(Char.to_upper, p.p_name),
                "n": big(String.size(p.p_name)),
                "head": String.substring(p.p_name, 0, 3),
                "joined": String.concat(String.tokens(lambda c: c == " ", p.p_name)),
                "words": big(F.size(String.tokens(Char.is_space, p.p_name))),
            }
        )
        .result()
    )


@query("SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS padded, ltrim(regexp_extract(s_name, '^[^0-9]*')) AS word FROM supplier")
def q_string_cvt(spark, d):
    return table(spark, d, "supplier", "s").yield_(lambda s: {"s_suppkey": s.s_suppkey, "padded": StringCvt.pad_left("0", 8, s.s_suppkey.cast("string")), "word": StringCvt.takel(lambda c: ~Char.is_digit(c), s.s_name)}).result()


@query("SELECT vec_id, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS DOUBLE), 3) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, round(CAST(embedding[1] AS DOUBLE), 5) AS head, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def q_list_functions(spark, d):
    return (
        table(spark, d, "embeddings", "e")
        .yield_(
            lambda e: {
                "vec_id": e.vec_id,
                "norm": F.round(List.foldl(lambda x, n: n + x * x, F.lit(0.0), List.map(lambda x: x.cast("double"), e.embedding)), 3),
                "positive": big(List.length(List.filter(lambda x: x > 0, e.embedding))),
                "head": F.round(List.hd(e.embedding).cast("double"), 5),
                "n": big(Bag.length(e.embedding)),
            }
        )
        .result()
    )


@query("SELECT vec_id, round(CAST(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS DOUBLE), 3) + 0 AS dot FROM embeddings")
def q_list_pair(spark, d):
    halves = lambda a: (List.map(lambda x: x.cast("double"), List.take(a, 32)), List.map(lambda x: x.cast("double"), List.drop(a, 32)))
    return table(spark, d, "embeddings", "e").yield_(lambda e: {"vec_id": e.vec_id, "dot": F.round(ListPair.foldl(lambda x, y, n: n + x * y, F.lit(0.0), *halves(e.embedding)), 3) + 0.0}).result()


@query("SELECT o_orderkey, CAST(coalesce(l_linenumber, -1) AS BIGINT) AS line, CAST(l_linenumber IS NOT NULL AS BIGINT) AS some FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49")
def q_option_functions(spark, d):
    return (
        table(spark, d, "orders", "o")
        .left_join("l", table(spark, d, "lineitem"), lambda o, l: (o.o_orderkey == l.l_orderkey) & (l.l_quantity > 49))
        .yield_(lambda o, l: {"o_orderkey": o.o_orderkey, "line": big(Option.get_opt(l.l_linenumber, -1)), "some": flag(Option.is_some(l.l_linenumber))})
        .result()
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_mktsegment END AS what FROM customer")
def q_either_functions(spark, d):
    either = lambda c: F.when(c.c_acctbal < 0, Either.inl("owes", "string")).otherwise(Either.inr(c.c_mktsegment, "string"))
    return table(spark, d, "customer", "c").yield_(lambda c: {"c_custkey": c.c_custkey, "what": Either.proj(either(c))}).result()


@query("SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(isodow(ts) - 1 AS BIGINT) AS w, CAST(dayofyear(ts) - 1 AS BIGINT) AS yd, strftime(ts, '%Y-%m-%d') AS text FROM events")
def q_date_functions(spark, d):
    date = lambda e: Date.of(e.ts)
    return (
        table(spark, d, "events", "e")
        .yield_(lambda e: {"event_id": e.event_id, "y": big(Date.year(date(e))), "m": big(Date.month(date(e))), "d": big(Date.day(date(e))), "h": big(Date.hour(date(e))), "w": big(Date.week_day(date(e))), "yd": big(Date.year_day(date(e))), "text": Date.fmt("%Y-%m-%d", date(e))})
        .result()
    )


@query("SELECT event_id, CAST(event_id * 1500 // 1000 AS BIGINT) AS s FROM events")
def q_time_functions(spark, d):
    return table(spark, d, "events", "e").yield_(lambda e: {"event_id": e.event_id, "s": big(Time.to_seconds(Time.from_milliseconds(e.event_id * 1500)))}).result()


@query("SELECT p_partkey, round(CAST(sqrt(p_size) AS DOUBLE), 3) AS root, round(CAST(ln(p_size) AS DOUBLE), 3) AS log, round(CAST(power(p_size, 2) AS DOUBLE), 1) AS square FROM part")
def q_math_functions(spark, d):
    out = lambda c, n: F.round(c.cast("double"), n)
    return table(spark, d, "part", "p").yield_(lambda p: {"p_partkey": p.p_partkey, "root": out(Math.sqrt(p.p_size), 3), "log": out(Math.ln(p.p_size), 3), "square": out(Math.pow(p.p_size, 2), 1)}).result()


@query("SELECT o_orderkey, CAST(o_orderkey & 255 AS BIGINT) AS low, CAST(xor(o_orderkey, o_custkey) AS BIGINT) AS mixed, CAST(o_orderkey << 3 AS BIGINT) AS up FROM orders")
def q_word_functions(spark, d):
    return table(spark, d, "orders", "o").yield_(lambda o: {"o_orderkey": o.o_orderkey, "low": Word.andb(o.o_orderkey, 255), "mixed": Word.xorb(o.o_orderkey, o.o_custkey), "up": Word.shl(o.o_orderkey, 3)}).result()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 5 AND l_quantity < 12) OR l_quantity > 48")
def q_range_sets(spark, d):
    ranges = RangeSet.continuous([Range.closed_open(5, 10), Range.closed_open(8, 12), Range.greater_than(48)])
    return table(spark, d, "lineitem", "l").where(lambda l: ranges.contains(l.l_quantity)).yield_(lambda l: {"l_orderkey": l.l_orderkey, "l_linenumber": l.l_linenumber}).result()


# ---------------------------------------------------------------- queries as text


def session(spark, d, *names: str) -> Session:
    return Session(spark, {n: table(spark, d, n) for n in names})


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment")
def q_text_group(spark, d):
    text = """
        from c in customer, o in orders
          where c.c_custkey = o.o_custkey andalso o.o_totalprice > 100000.0
          group {c.c_mktsegment} compute {n = count over (), s = sum over o.o_orderkey};
    """
    return session(spark, d, "customer", "orders").run(text).result()


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'seven' WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def q_text_functions(spark, d):
    """A user's function is inlined; membership in another query becomes an anti join."""
    text = """
        fun kind n = if n mod 7 = 0 then "seven" else if n > 25 then "large" else "small";
        val big = from p in part where p.p_size = 50 yield p.p_brand;
        from p in part where p.p_brand notelem big yield {p.p_partkey, kind = kind p.p_size};
    """
    return session(spark, d, "part").run(text).result()


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 2")
def q_text_order(spark, d):
    return session(spark, d, "customer").run("from c in customer order (DESC c.c_acctbal, c.c_custkey) skip 2 take 5 yield {c.c_custkey, c.c_name};").result()


@query("SELECT n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 7000) ON n_nationkey = s_nationkey")
def q_text_left_join(spark, d):
    text = "from n in nation left join s in (from x in supplier where x.s_acctbal > 7000.0) on n.n_nationkey = s.s_nationkey yield {n.n_name, s.s_suppkey};"
    return session(spark, d, "nation", "supplier").run(text).result()
