"""Queries written in the textual language, over whole tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.rel import Rel
from tessera.plans.lang import Session
from tessera.plans.library import compared, shown
from tessera.sources.tables import parquet


def ran(spark, d, text: str, *tables: str, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows of the last statement; tables are bags, or lists in the order of the columns given."""
    sources = {t: Rel.bag(parquet(spark, d, t), t) for t in tables} | {t: Rel.list(parquet(spark, d, t), by, t) for t, by in (lists or {}).items()}
    df = Session(spark, sources).run(text).result()
    return shown(df, df.columns, {})


@compared("k v", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN c_nationkey * 2 WHEN c_nationkey = 0 THEN 0 - 1 ELSE c_nationkey + 100 END AS v FROM customer")
def q_text_datatype(spark, d):
    """A sum type whose values are made of rows and taken apart by constructor patterns."""
    return ran(
        spark, d,
        """datatype standing = Owes of int | Nowhere | Has of int;
        fun standing c = if c.c_acctbal < 0.0 then Owes c.c_nationkey else if c.c_nationkey = 0 then Nowhere else Has c.c_nationkey;
        fun number (Owes n) = n * 2 | number Nowhere = ~1 | number (Has n) = n + 100;
        from c in customer yield {k = c.c_custkey, v = number (standing c)};""",
        "customer",
    )


@compared("key side", "SELECT n_nationkey AS key, n_name, CASE WHEN s.kind = 'Circle' THEN s.size ELSE s.size * 2 END AS side FROM nation JOIN (VALUES ('Circle', 1), ('Square', 2), ('Square', 3)) s(kind, size) ON s.size = n_regionkey")
def q_text_datatype_scan(spark, d):
    """A list of a datatype's values as a source, with a constructor pattern over its rows."""
    return ran(
        spark, d,
        """datatype shape = Circle of int | Square of int;
        fun size s = case s of Circle r => r | Square x => x;
        from s in [Circle 1, Square 2, Square 3], n in nation where size s = n.n_regionkey
          yield {key = n.n_nationkey, n.n_name, side = case s of Circle r => r | Square x => x * 2};""",
        "nation",
    )


@compared("k n r", "SELECT n_nationkey AS k, n_regionkey * 10 AS n, n_nationkey + 1 AS r, n_name || '!' AS t FROM nation")
def q_text_modifiers(spark, d):
    """Record update and the other modifiers."""
    return ran(
        spark, d,
        """from e in nation
          yield {{e with n_regionkey = e.n_regionkey * 10} replace n_name = n_name ^ "!" extend r = n_nationkey + 1 extend or skip r = 0 rename k = n_nationkey rename n = n_regionkey rename t = n_name remove or skip nothing};""",
        "nation",
    )


@compared("k place", "SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS place FROM supplier")
def q_text_ordinal(spark, d):
    return ran(spark, d, "from s in supplier order (DESC s.s_acctbal, s.s_suppkey) yield {k = s.s_suppkey, place = ordinal};", "supplier")


@compared("k", "SELECT s_suppkey AS k FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS p FROM supplier) WHERE p % 4 = 1")
def q_text_ordinal_filter(spark, d):
    return ran(spark, d, "from s in supplier order (s.s_name, s.s_suppkey) where ordinal mod 4 = 1 yield {k = s.s_suppkey};", "supplier")


@compared("i", "SELECT i, n_name FROM nation JOIN (VALUES (1), (2), (3), (7), (11), (12)) r(i) ON n_nationkey = i")
def q_text_ranges(spark, d):
    """Closed, half-open and open ranges beside points."""
    return ran(spark, d, "from i in [1 .. 2, 2 ^.. 3, 7, 10 ^..^ 13] join n in nation on n.n_nationkey = i yield {i, n.n_name};", "nation")


@compared("k", "SELECT p_partkey AS k FROM part WHERE (p_size >= 1 AND p_size < 5) OR p_size = 10 OR p_size >= 45")
def q_text_range_membership(spark, d):
    """A range without an end: a comparison, nothing is enumerated."""
    return ran(spark, d, "from p in part where p.p_size elem [1 ..^ 5, 10, 45 ..] yield {k = p.p_partkey};", "part")


@compared("k", "SELECT o_orderkey AS k, c_name AS who FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal < 0")
def q_text_safe_navigation(spark, d):
    return ran(spark, d, "from o in orders left join c in customer on o.o_custkey = c.c_custkey andalso c.c_acctbal < 0.0 yield {k = o.o_orderkey, who = c?.c_name};", "orders", "customer")


@compared("k v", "SELECT o_orderkey AS k, coalesce(n, 0 - 1) AS v FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey AS n FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey")
def q_text_option_patterns(spark, d):
    """SOME and NONE take an outer join's row apart."""
    return ran(
        spark, d,
        """from o in orders left join c in customer on o.o_custkey = c.c_custkey andalso c.c_acctbal < 0.0
          yield {k = o.o_orderkey, v = case c of SOME r => r.c_nationkey | NONE => ~1};""",
        "orders", "customer",
    )


@compared("k v", "SELECT n_nationkey AS k, 100 // (n_regionkey + 1) AS v FROM nation")
def q_text_raise(spark, d):
    """An exception in a branch that no row takes."""
    return ran(spark, d, "fun share n = if n < 0 then raise Domain else if n = 0 then raise Fail \"none\" else 100 div n; from n in nation yield {k = n.n_nationkey, v = share (n.n_regionkey + 1)};", "nation")


@compared("k a", "SELECT n_nationkey AS k, n_regionkey + n_nationkey AS a FROM nation WHERE n_regionkey = 2")
def q_text_patterns(spark, d):
    """A record pattern that leaves fields out, a constant in it, and a name for the whole."""
    return ran(spark, d, "fun total (r as {n_nationkey, ...}) = r.n_regionkey + n_nationkey; from {n_regionkey = 2, n_nationkey = k, ...} in nation yield {k, a = k + 2};", "nation")


@compared("total rows", "SELECT CAST(sum(n_nationkey) AS BIGINT) AS total, count(*) AS rows FROM nation")
def q_text_into(spark, d):
    """into with an aggregate of the library."""
    s = Session(spark, {"nation": Rel.bag(parquet(spark, d, "nation"), "nation")})
    total, rows = s.run("from n in nation yield n.n_nationkey into sum;"), s.run("from n in nation into count;")
    return spark.createDataFrame([(int(total), int(rows))], "total bigint, rows bigint")
