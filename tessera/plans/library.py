"""Queries over the function library: the members of each structure over whole tables, and the same as SQL.

Each member is a column. Truth values and integers are bigint; reals are compared as the double of a single.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.base import order
from tessera.functions.collections import Bag, Either, List, ListPair, Option, Vector
from tessera.functions.general import Fn, General, Relational
from tessera.functions.numbers import Bool, Int, Math, Real, Word
from tessera.functions.ranges import Range, RangeSet, flatten
from tessera.functions.strings import Char, String, StringCvt
from tessera.functions.times import Date, Time
from tessera.plans.registry import query
from tessera.sources.tables import parquet


def shown(df: DataFrame, key: list[str], members: dict[str, Column]) -> DataFrame:
    """key and a column for each member; truth values and whole numbers as bigint, singles as double."""
    out = df.select(*key, *(c.alias(n) for n, c in members.items()))
    kinds = dict(out.dtypes)
    wide = {"int": "bigint", "boolean": "bigint", "float": "double"}
    return out.select(*(F.col(n).cast(wide[kinds[n]]).alias(n) if kinds[n] in wide else F.col(n) for n in out.columns))


def compared(integers: str, sql: str):
    """Registers a query with its SQL, of which these columns are cast to bigint."""
    casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in integers.split())
    return query(f"SELECT * REPLACE ({casts}) FROM ({sql})")


def text(array: Column) -> Column:
    """An array as text, its elements joined by commas."""
    return F.array_join(array.cast("array<string>"), ",")


# ---------------------------------------------------------------- Int

INTS = "SELECT l_orderkey, l_linenumber, CAST(l_suppkey * 37 % 2001 - 1000 AS INTEGER) AS a, CAST(l_linenumber * 2 - 7 AS INTEGER) AS b FROM lineitem"


def ints(spark, d) -> DataFrame:
    return parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") * 37 % 2001 - 1000).cast("int").alias("a"), (F.col("l_linenumber") * 2 - 7).cast("int").alias("b"))


@compared("l_linenumber add sub mul rem neg abs min max sign to_large from_large to_int from_int precision min_int max_int", f"""WITH t AS ({INTS}) SELECT l_orderkey, l_linenumber, a + b AS "add", a - b AS sub, a * b AS mul, CAST(floor(a / b) AS BIGINT) AS "div", CAST(a - b * floor(a / b) AS BIGINT) AS "mod", CAST(trunc(a / b) AS BIGINT) AS quot, a % b AS rem,
  -a AS neg, abs(a) AS "abs", least(a, b) AS "min", greatest(a, b) AS "max", sign(a) AS "sign", CAST(sign(a) = sign(b) AS BIGINT) AS same_sign, CAST(a < b AS BIGINT) AS lt, CAST(a <= b AS BIGINT) AS le, CAST(a > b AS BIGINT) AS gt, CAST(a >= b AS BIGINT) AS ge,
  CASE WHEN a < b THEN 'LESS' WHEN a = b THEN 'EQUAL' ELSE 'GREATER' END AS compare, a AS to_large, a AS from_large, a AS to_int, a AS from_int, 32 AS "precision", -2147483648 AS min_int, 2147483647 AS max_int FROM t""")
def q_lib_int(spark, d):
    t, a, b = ints(spark, d), F.col("a"), F.col("b")
    two = {n: getattr(Int, n)(a, b) for n in ("add", "sub", "mul", "div", "mod", "quot", "rem", "min", "max", "same_sign", "lt", "le", "gt", "ge", "compare")}
    one = {n: getattr(Int, n)(a) for n in ("neg", "abs", "sign", "to_large", "from_large", "to_int", "from_int")}
    return shown(t, ["l_orderkey", "l_linenumber"], two | one | {"precision": F.lit(Int.precision), "min_int": F.lit(Int.min_int), "max_int": F.lit(Int.max_int)})


@compared("l_linenumber from_string scanned_bin scanned_oct scanned_dec scanned_hex", f"""WITH t AS ({INTS}), s AS (SELECT *, CASE WHEN a < 0 THEN '~' ELSE '' END AS m, abs(a) AS p FROM t) SELECT l_orderkey, l_linenumber, m || p AS to_string, m || to_base(p, 2) AS bin, m || to_base(p, 8) AS oct, m || p AS "dec", m || to_base(p, 16) AS hex,
  a AS from_string, CAST(NULL AS BIGINT) AS from_nothing, a AS scanned_bin, a AS scanned_oct, a AS scanned_dec, a AS scanned_hex, ' rest' AS rest FROM s""")
def q_lib_int_text(spark, d):
    t, a = ints(spark, d), F.col("a")
    forms = {"bin": "BIN", "oct": "OCT", "dec": "DEC", "hex": "HEX"}
    scans = {n: Int.scan(r, F.concat(F.lit(" \t"), Int.fmt(r, a), F.lit(" rest"))) for n, r in forms.items()}
    return shown(
        t,
        ["l_orderkey", "l_linenumber"],
        {"to_string": Int.to_string(a)}
        | {n: Int.fmt(r, a) for n, r in forms.items()}
        | {"from_string": Int.from_string(F.concat(F.lit("  "), Int.to_string(a), F.lit("x7"))), "from_nothing": Int.from_string(F.concat(F.lit("x"), Int.to_string(a)))}
        | {f"scanned_{n}": s["_1"] for n, s in scans.items()}
        | {"rest": scans["hex"]["_2"]},
    )


# ---------------------------------------------------------------- Real

REALS = "SELECT l_orderkey, l_linenumber, CAST(l_quantity * 4 - 101 AS FLOAT) / CAST(8 AS FLOAT) AS x, CAST(l_linenumber - 3.5 AS FLOAT) AS y FROM lineitem"
AS_DOUBLE = lambda e, n: f'CAST(CAST({e} AS FLOAT) AS DOUBLE) AS "{n}"'


def reals(spark, d) -> DataFrame:
    return parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") * 4 - 101).cast("float") / 8).cast("float").alias("x"), (F.col("l_linenumber") - 3.5).cast("float").alias("y"))


@compared("l_linenumber unordered is_finite is_nan is_normal radix precision", f"""WITH t AS ({REALS}) SELECT l_orderkey, l_linenumber, {AS_DOUBLE("x + y", "add")}, {AS_DOUBLE("x - y", "sub")}, {AS_DOUBLE("x * y", "mul")}, {AS_DOUBLE("x / y", "div")}, {AS_DOUBLE("x % y", "rem")}, {AS_DOUBLE("-x", "neg")}, {AS_DOUBLE("abs(x)", "abs")},
  {AS_DOUBLE("least(x, y)", "min")}, {AS_DOUBLE("greatest(x, y)", "max")}, CAST(sign(x) AS BIGINT) AS "sign", CAST(x < 0 AS BIGINT) AS sign_bit, CAST((x < 0) = (y < 0) AS BIGINT) AS same_sign, {AS_DOUBLE("CASE WHEN y < 0 THEN -abs(x) ELSE abs(x) END", "copy_sign")},
  CASE WHEN x < y THEN 'LESS' WHEN x = y THEN 'EQUAL' ELSE 'GREATER' END AS compare, CAST(x < y AS BIGINT) AS lt, CAST(x <= y AS BIGINT) AS le, CAST(x > y AS BIGINT) AS gt, CAST(x >= y AS BIGINT) AS ge, CAST(x = y AS BIGINT) AS eq, CAST(x <> y AS BIGINT) AS ne,
  0 AS "unordered", 1 AS is_finite, 0 AS is_nan, 1 AS is_normal, {AS_DOUBLE("x", "back")}, {AS_DOUBLE("x - trunc(x)", "frac")}, {AS_DOUBLE("trunc(x)", "whole")}, {AS_DOUBLE("x - trunc(x)", "real_mod")}, {AS_DOUBLE("x", "check_float")},
  {AS_DOUBLE("floor(x)", "real_floor")}, {AS_DOUBLE("ceil(x)", "real_ceil")}, {AS_DOUBLE("trunc(x)", "real_trunc")}, {AS_DOUBLE("round_even(x, 0)", "real_round")}, CAST(floor(x) AS BIGINT) AS "floor", CAST(ceil(x) AS BIGINT) AS "ceil", CAST(trunc(x) AS BIGINT) AS "trunc", CAST(round_even(x, 0) AS BIGINT) AS "round",
  CAST(l_linenumber AS DOUBLE) AS from_int, 2 AS radix, 24 AS "precision" FROM t""")
def q_lib_real(spark, d):
    t, x, y = reals(spark, d), F.col("x"), F.col("y")
    two = {n: getattr(Real, n)(x, y) for n in ("add", "sub", "mul", "div", "rem", "min", "max", "same_sign", "copy_sign", "compare", "lt", "le", "gt", "ge", "eq", "ne", "unordered")}
    one = {n: getattr(Real, n)(x) for n in ("neg", "abs", "sign", "sign_bit", "is_finite", "is_nan", "is_normal", "real_mod", "check_float", "real_floor", "real_ceil", "real_trunc", "real_round", "floor", "ceil", "trunc", "round")}
    split = Real.split(x)
    more = {"back": Real.from_man_exp(Real.to_man_exp(x)), "frac": split["frac"], "whole": split["whole"], "from_int": Real.from_int(F.col("l_linenumber")), "radix": F.lit(Real.radix), "precision": F.lit(Real.precision)}
    return shown(t, ["l_orderkey", "l_linenumber"], two | one | more)


@compared("n_nationkey is_finite is_normal", """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'nan' WHEN n_nationkey % 3 = 1 THEN 'inf' ELSE '~inf' END AS to_string, CAST(n_nationkey % 3 = 0 AS BIGINT) AS is_nan, 0 AS is_finite, 0 AS is_normal, CAST(n_nationkey % 3 = 0 AS BIGINT) AS "unordered",
  CAST(n_nationkey % 3 <> 0 AS BIGINT) AS eq, CAST(n_nationkey % 3 = 2 AS BIGINT) AS lt, CAST(n_nationkey % 3 = 1 AS BIGINT) AS gt, CAST(1 AS DOUBLE) AS smallest, CAST(3.4028234663852886e38 AS DOUBLE) AS max_finite, CAST(1.401298464324817e-45 AS DOUBLE) AS min_pos, CAST(1.1754943508222875e-38 AS DOUBLE) AS min_normal_pos FROM nation""")
def q_lib_real_special(spark, d):
    """nan, inf and ~inf by turns."""
    k = F.col("n_nationkey") % 3
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(Real.pos_inf)).otherwise(F.lit(Real.neg_inf)).cast("float")
    one = {n: getattr(Real, n)(x) for n in ("to_string", "is_nan", "is_finite", "is_normal")}
    more = {
        "unordered": Real.unordered(x, F.lit(0.0)), "eq": Real.eq(x, x), "lt": Real.lt(x, F.lit(0.0)), "gt": Real.gt(x, F.lit(0.0)), "smallest": Real.min(F.when(k == 0, x).otherwise(F.lit(1.0).cast("float")), F.lit(1.0)).cast("double"),
        "max_finite": F.lit(Real.max_finite), "min_pos": F.lit(Real.min_pos), "min_normal_pos": F.lit(Real.min_normal_pos),
    }
    return shown(parquet(spark, d, "nation"), ["n_nationkey"], one | more)


@query("""WITH t AS (SELECT s_suppkey, CAST(round(s_acctbal, 0) AS BIGINT) AS n FROM supplier), v AS (SELECT s_suppkey, n, CAST(n AS DOUBLE) / 16 AS x, CASE WHEN n < 0 THEN '~' ELSE '' END AS m FROM t)
  SELECT s_suppkey, m || format('{:.4f}', abs(x)) AS fix, m || abs(n) AS whole, CAST(CAST(x AS FLOAT) AS DOUBLE) AS from_string, CAST(CAST(x AS FLOAT) AS DOUBLE) AS scanned, 'kg' AS rest, CAST(CAST(x AS FLOAT) AS DOUBLE) AS exact FROM v""")
def q_lib_real_text(spark, d):
    n = F.round("s_acctbal", 0).cast("long")
    x = (n.cast("double") / 16).cast("float")
    scanned = Real.scan(F.concat(F.lit(" "), Real.fmt("FIX", x, 4), F.lit("kg")))
    return shown(
        parquet(spark, d, "supplier"),
        ["s_suppkey"],
        {"fix": Real.fmt("FIX", x, 4), "whole": Real.to_string(n.cast("float")), "from_string": Real.from_string(Real.to_string(x)), "scanned": scanned["_1"], "rest": scanned["_2"], "exact": Real.from_string(Real.fmt("EXACT", x))},
    )


# ---------------------------------------------------------------- Math

ANGLES = "sin cos tan atan exp tanh".split()
ROUNDED = lambda e, n: f'round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 3) + 0.0 AS "{n}"'


@query("WITH t AS (SELECT p_partkey, p_size / 50.0 AS x, CAST(p_size AS DOUBLE) AS n FROM part) SELECT p_partkey, " + ", ".join([*(ROUNDED(f"{f}(x)", f) for f in [*ANGLES, "asin", "acos", "sinh", "cosh", "ln", "log10", "sqrt"]), ROUNDED("atan2(x, n)", "atan2"), ROUNDED("pow(n, x)", "pow"), "round(pi(), 6) AS pi, round(exp(1), 6) AS e"]) + " FROM t")
def q_lib_math(spark, d):
    x, n = F.col("p_size") / 50.0, F.col("p_size").cast("double")
    near = lambda c: F.round(c.cast("double"), 3) + 0.0
    one = {f: near(getattr(Math, f)(x)) for f in [*ANGLES, "asin", "acos", "sinh", "cosh", "ln", "log10", "sqrt"]}
    return shown(parquet(spark, d, "part"), ["p_partkey"], one | {"atan2": near(Math.atan2(x, n)), "pow": near(Math.pow(n, x)), "pi": F.round(F.lit(Math.pi), 6), "e": F.round(F.lit(Math.e), 6)})


# ---------------------------------------------------------------- Word

WORDS = "SELECT o_orderkey, o_orderkey * 2654435761 - o_custkey * 40503 * 65536 * 4096 AS a, o_custkey * 97 - 5000 AS b FROM orders"
UNSIGNED = "CASE WHEN {0} < 0 THEN CAST({0} AS HUGEINT) + 18446744073709551616 ELSE CAST({0} AS HUGEINT) END"
SIGNED = lambda e, n: f'CAST(CASE WHEN ({e}) % 18446744073709551616 >= 9223372036854775808 THEN ({e}) % 18446744073709551616 - 18446744073709551616 ELSE ({e}) % 18446744073709551616 END AS BIGINT) AS "{n}"'


@compared("word_size", 
    f"WITH t AS ({WORDS}), u AS (SELECT *, {UNSIGNED.format('a')} AS p, CASE WHEN b = 0 THEN CAST(1 AS HUGEINT) ELSE {UNSIGNED.format('b')} END AS q, o_orderkey % 70 AS k FROM t) SELECT o_orderkey, "
    + ", ".join(
        [
            SIGNED("p + q", "add"), SIGNED("p + 18446744073709551616 - q", "sub"), SIGNED("(p % 4294967296) * q % 18446744073709551616 + (((p // 4294967296) * (q % 4294967296)) % 4294967296) * 4294967296", "mul"), SIGNED("p // q", "div"), SIGNED("p % q", "mod"),
            SIGNED("18446744073709551616 - p", "neg"), SIGNED("least(p, q)", "min"), SIGNED("greatest(p, q)", "max"), "CAST(p < q AS BIGINT) AS lt, CAST(p <= q AS BIGINT) AS le, CAST(p > q AS BIGINT) AS gt, CAST(p >= q AS BIGINT) AS ge",
            "CASE WHEN p < q THEN 'LESS' WHEN p = q THEN 'EQUAL' ELSE 'GREATER' END AS compare, a | (CASE WHEN b = 0 THEN 1 ELSE b END) AS orb, -a - 1 AS notb",
            "CASE WHEN k < 64 THEN CAST(p // CAST(pow(2, least(k, 63)) AS HUGEINT) % 9223372036854775808 + CASE WHEN p // CAST(pow(2, least(k, 63)) AS HUGEINT) >= 9223372036854775808 THEN -9223372036854775808 ELSE 0 END AS BIGINT) ELSE 0 END AS shr, CASE WHEN k < 64 THEN a >> least(k, 63) WHEN a < 0 THEN -1 ELSE 0 END AS sar",
            "upper(to_base(CAST(o_orderkey AS BIGINT), 16)) AS hex, upper(to_base(o_orderkey, 2)) AS bin, upper(to_base(o_orderkey, 16)) AS to_string, o_orderkey AS scanned, 'z' AS rest, o_orderkey AS from_string, o_orderkey AS to_int, o_orderkey AS to_int_x, CAST(-o_orderkey AS BIGINT) AS to_large_int_x, o_orderkey AS to_large_int, 64 AS word_size",
            "a AS to_large, a AS to_large_x, a AS to_large_word, a AS to_large_word_x, a AS from_large, a AS from_large_word, a AS from_large_int, a AS from_int",
        ]
    )
    + " FROM u"
)
def q_lib_word(spark, d):
    key, wide = F.col("o_orderkey"), lambda n: F.col(n).cast("decimal(19,0)")
    # words wrap: from o_custkey 848326 on, the product leaves a bigint
    a, b = Word.narrow((wide("o_orderkey") * F.lit(2654435761) - wide("o_custkey") * F.lit(40503 * 65536 * 4096)).cast("decimal(38,0)")), F.col("o_custkey") * 97 - 5000
    t = parquet(spark, d, "orders").select(key, a.alias("a"), F.when(b == 0, 1).otherwise(b).alias("b"), (key % 70).alias("k"))
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    two = {n: getattr(Word, n)(a, b) for n in ("add", "sub", "mul", "div", "mod", "min", "max", "lt", "le", "gt", "ge", "compare", "orb")}
    one = {n: getattr(Word, n)(a) for n in ("neg", "notb", "to_large", "to_large_x", "to_large_word", "to_large_word_x", "from_large", "from_large_word", "from_large_int", "from_int")}
    scanned = Word.scan("HEX", F.concat(F.lit(" 0wx"), Word.to_string(key), F.lit("z")))
    more = {
        "shr": Word.shr(a, k), "sar": Word.sar(a, k), "hex": Word.fmt("HEX", key), "bin": Word.fmt("BIN", key), "to_string": Word.to_string(key), "scanned": scanned["_1"], "rest": scanned["_2"], "from_string": Word.from_string(Word.to_string(key)),
        "to_int": Word.to_int(key), "to_int_x": Word.to_int_x(key), "to_large_int_x": Word.to_large_int_x(-key), "to_large_int": Word.to_large_int(key), "word_size": F.lit(Word.word_size),
    }
    return shown(t, ["o_orderkey"], two | one | more)


# ---------------------------------------------------------------- Bool


@query("""WITH t AS (SELECT p_partkey, p_size > 25 AS a, p_retailprice > 1300 AS b FROM part) SELECT p_partkey, CAST(NOT a AS BIGINT) AS not_, CAST(a AND b AS BIGINT) AS andalso, CAST(a OR b AS BIGINT) AS orelse, CAST(a = b AS BIGINT) AS eq, CAST(a <> b AS BIGINT) AS ne, CAST(a < b AS BIGINT) AS lt, CAST(a > b AS BIGINT) AS gt,
  CASE WHEN a THEN 'true' ELSE 'false' END AS to_string, CAST(a AS BIGINT) AS from_string, CAST(b AS BIGINT) AS scanned, '!' AS rest, CASE WHEN a = b THEN 'EQUAL' WHEN b THEN 'LESS' ELSE 'GREATER' END AS compare FROM t""")
def q_lib_bool(spark, d):
    a, b = F.col("p_size") > 25, F.col("p_retailprice") > 1300
    scanned = Bool.scan(F.concat(F.lit("  "), F.upper(Bool.to_string(b)), F.lit("!")))
    two = {n: getattr(Bool, n)(a, b) for n in ("andalso", "orelse", "eq", "ne", "lt", "gt", "compare")}
    return shown(parquet(spark, d, "part"), ["p_partkey"], two | {"not_": Bool.not_(a), "to_string": Bool.to_string(a), "from_string": Bool.from_string(Bool.to_string(a)), "scanned": scanned["_1"], "rest": scanned["_2"]})


# ---------------------------------------------------------------- Char

CLASSES = {
    "is_ascii": "i < 128", "is_alpha": "i BETWEEN 65 AND 90 OR i BETWEEN 97 AND 122", "is_alpha_num": "i BETWEEN 48 AND 57 OR i BETWEEN 65 AND 90 OR i BETWEEN 97 AND 122", "is_cntrl": "i < 32 OR i = 127", "is_digit": "i BETWEEN 48 AND 57",
    "is_graph": "i BETWEEN 33 AND 126", "is_hex_digit": "i BETWEEN 48 AND 57 OR i BETWEEN 65 AND 70 OR i BETWEEN 97 AND 102", "is_oct_digit": "i BETWEEN 48 AND 55", "is_lower": "i BETWEEN 97 AND 122", "is_print": "i BETWEEN 32 AND 126",
    "is_space": "i BETWEEN 9 AND 13 OR i = 32", "is_punct": "i BETWEEN 33 AND 126 AND NOT (i BETWEEN 48 AND 57 OR i BETWEEN 65 AND 90 OR i BETWEEN 97 AND 122)", "is_upper": "i BETWEEN 65 AND 90",
}


@compared("max_ord min_ord", 
    "SELECT i, " + ", ".join(f"CAST({test} AS BIGINT) AS {n}" for n, test in CLASSES.items())
    + ", chr(CAST(CASE WHEN i BETWEEN 65 AND 90 THEN i + 32 ELSE i END AS INTEGER)) AS to_lower, chr(CAST(CASE WHEN i BETWEEN 97 AND 122 THEN i - 32 ELSE i END AS INTEGER)) AS to_upper, i AS ord, chr(CAST(i + 1 AS INTEGER)) AS succ, i AS back, chr(CAST(i AS INTEGER)) AS from_int, chr(CAST(i AS INTEGER)) AS unescaped, chr(CAST(i AS INTEGER)) AS scanned, 'zz' AS rest,"
    + " CASE WHEN i < 97 THEN 'LESS' WHEN i = 97 THEN 'EQUAL' ELSE 'GREATER' END AS compare, CAST(i < 97 AS BIGINT) AS lt, CAST(i <= 97 AS BIGINT) AS le, CAST(i > 97 AS BIGINT) AS gt, CAST(i >= 97 AS BIGINT) AS ge, CAST(i = 97 AS BIGINT) AS eq, CAST(i <> 97 AS BIGINT) AS ne, CAST(i IN (97, 98) AS BIGINT) AS contains, CAST(i NOT IN (97, 98) AS BIGINT) AS not_contains,"
    + " CASE i WHEN 34 THEN '\\\"' WHEN 92 THEN '\\\\' ELSE CASE WHEN i < 127 THEN chr(CAST(i AS INTEGER)) ELSE '\\' || i END END AS to_string, CASE WHEN i IN (34, 39, 63, 92) THEN '\\' || chr(CAST(i AS INTEGER)) WHEN i < 127 THEN chr(CAST(i AS INTEGER)) ELSE '\\' || to_base(i, 8) END AS to_c_string, chr(CAST(i AS INTEGER)) AS from_c_string, 255 AS max_ord, 0 AS min_ord, chr(255) AS max_char FROM range(32, 255) r(i)"
)
def q_lib_char(spark, d):
    """Every character from the space on."""
    t, i = spark.range(32, 255).select(F.col("id").cast("int").alias("i")), F.col("i")
    c = Char.chr(i)
    scanned = Char.scan(F.concat(Char.to_string(c), F.lit("zz")))
    two = {n: getattr(Char, n)(c, F.lit("a")) for n in ("compare", "lt", "le", "gt", "ge", "eq", "ne")}
    more = {
        "to_lower": Char.to_lower(c), "to_upper": Char.to_upper(c), "ord": Char.ord(c), "succ": Char.succ(c), "back": Char.ord(Char.pred(Char.succ(c))), "from_int": Char.from_int(i), "unescaped": Char.from_string(Char.to_string(c)), "scanned": scanned["_1"], "rest": scanned["_2"],
        "contains": Char.contains(F.lit("ab"), c), "not_contains": Char.not_contains(F.lit("ab"), c), "to_string": Char.to_string(c), "to_c_string": Char.to_c_string(c), "from_c_string": Char.from_c_string(Char.to_c_string(c)),
        "max_ord": F.lit(Char.max_ord), "min_ord": F.ascii(F.lit(Char.min_char)), "max_char": F.lit(Char.max_char),
    }
    return shown(t, ["i"], {n: getattr(Char, n)(c) for n in CLASSES} | two | more).withColumn("i", F.col("i").cast("bigint"))


# ---------------------------------------------------------------- String and StringCvt


@compared("max_size", """WITH t AS (SELECT p_partkey, p_name AS s, p_type AS u FROM part) SELECT p_partkey, s[2] AS sub, s[3:] AS extract_, s[2:3] AS extract_some, s || u AS cat, s || '-' || u AS concat_with, s[1] AS str, s AS implode, length(s) AS explode, replace(s, ' ', '__') AS translate,
  list_aggregate(string_split(s, ' '), 'string_agg', '/') AS fields, CAST(starts_with(s, 'a') AS BIGINT) AS is_prefix, CAST(contains(s, 'ee') AS BIGINT) AS is_substring, CAST(ends_with(s, 'e') AS BIGINT) AS is_suffix, CASE WHEN s < u THEN 'LESS' WHEN s = u THEN 'EQUAL' ELSE 'GREATER' END AS compare, CASE WHEN s < u THEN 'LESS' WHEN s = u THEN 'EQUAL' ELSE 'GREATER' END AS collate_,
  CAST(s < u AS BIGINT) AS lt, CAST(s <= u AS BIGINT) AS le, CAST(s > u AS BIGINT) AS gt, CAST(s >= u AS BIGINT) AS ge, CAST(s = u AS BIGINT) AS eq, CAST(s <> u AS BIGINT) AS ne, s || '\\"\\n' AS to_string, s || '\\"\\n' AS to_c_string, s || '"' || chr(10) AS from_string, s || '"' || chr(10) AS from_c_string, s AS scanned, '\\q' AS rest, 16777215 AS max_size FROM t""")
def q_lib_string(spark, d):
    s, u = F.col("p_name"), F.col("p_type")
    hard = F.concat(s, F.lit('"\n'))
    scanned = String.scan(F.concat(s, F.lit("\\q")))
    two = {n: getattr(String, n)(s, u) for n in ("compare", "lt", "le", "gt", "ge", "eq", "ne")}
    more = {
        "sub": String.sub(s, 1), "extract_": String.extract(s, 2), "extract_some": String.extract(s, 1, 2), "cat": String.cat(s, u), "concat_with": String.concat_with("-", F.array(s, u)), "str": String.str(String.sub(s, 0)), "implode": String.implode(String.explode(s)), "explode": F.size(String.explode(s)),
        "translate": String.translate(lambda c: F.when(c == " ", "__").otherwise(c), s), "fields": String.concat_with("/", String.fields(Char.is_space, s)), "is_prefix": String.is_prefix("a", s), "is_substring": String.is_substring("ee", s), "is_suffix": String.is_suffix("e", s), "collate_": String.collate(Char.compare, s, u),
        "to_string": String.to_string(hard), "to_c_string": String.to_c_string(hard), "from_string": String.from_string(String.to_string(hard)), "from_c_string": String.from_c_string(String.to_c_string(hard)), "scanned": scanned["_1"], "rest": scanned["_2"], "max_size": F.lit(String.max_size),
    }
    return shown(parquet(spark, d, "part"), ["p_partkey"], two | more)


@query("""SELECT o_orderkey, rpad(o_orderstatus, 4, '*') AS pad_right, o_orderpriority[1] AS taken, o_orderpriority[2:] AS dropped, o_orderpriority[1] AS split_1, o_orderpriority[2:] AS split_2, o_orderpriority AS skipped, CAST(o_orderpriority[1] AS BIGINT) AS scanned FROM orders""")
def q_lib_string_cvt(spark, d):
    p = F.col("o_orderpriority")
    split = StringCvt.splitl(Char.is_digit, p)
    return shown(
        parquet(spark, d, "orders"),
        ["o_orderkey"],
        {"pad_right": StringCvt.pad_right("*", 4, F.col("o_orderstatus")), "taken": StringCvt.takel(Char.is_digit, p), "dropped": StringCvt.dropl(Char.is_digit, p), "split_1": split["_1"], "split_2": split["_2"], "skipped": StringCvt.skip_ws(F.concat(F.lit(" \t\n"), p)), "scanned": StringCvt.scan_string(lambda s: Int.scan("DEC", s), p)},
    )


# ---------------------------------------------------------------- List, Bag, Vector

LISTS = "SELECT o_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_quantity, l_discount) AS a, list(CAST(round(l_discount * 100) AS INTEGER) ORDER BY l_linenumber, l_quantity, l_discount) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


def lists(spark, d) -> DataFrame:
    """The quantities and the discounts of each order's lines, in their order."""
    l = parquet(spark, d, "lineitem").join(parquet(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    g = l.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("x")))).alias("g"))
    return g.select("o_orderkey", F.col("g.q").alias("a"), F.col("g.x").alias("b"))


JOINED = lambda e, n: f"list_aggregate(CAST({e} AS VARCHAR[]), 'string_agg', ',') AS {n}"
OR_NONE = lambda e, n: f"coalesce(list_aggregate(CAST({e} AS VARCHAR[]), 'string_agg', ','), '') AS {n}"
ELEMENTS = ", ".join(
    [
        "CAST(len(a) = 0 AS BIGINT) AS null_", "len(a) AS length", JOINED("list_concat(a, b)", "at"), "a[1] AS hd", OR_NONE("a[2:]", "tl"), "a[len(a)] AS last", "a[1] AS item_hd", OR_NONE("a[2:]", "item_tl"), "a[len(a)] AS nth", "a[1] AS only",
        OR_NONE("a[:len(a) // 2]", "take"), OR_NONE("a[len(a) // 2 + 1:]", "drop"), JOINED("list_reverse(a)", "rev"), JOINED("list_concat(a, b)", "concat"), JOINED("list_concat(list_reverse(a), b)", "rev_append"),
        JOINED("list_transform(a, lambda x: x * 2 + 1)", "map"), JOINED("list_transform(a, lambda x, i: x + i - 1)", "mapi"), OR_NONE("list_transform(list_filter(a, lambda x: x > 25), lambda x: x - 25)", "map_partial"), "list_filter(a, lambda x: x > 25)[1] AS find",
        OR_NONE("list_filter(a, lambda x: x > 25)", "filter"), OR_NONE("list_filter(a, lambda x: x > 25)", "part_1"), OR_NONE("list_filter(a, lambda x: x <= 25)", "part_2"),
        "list_reduce(a, lambda n, x: (n * 7 + x) % 1009, 1) AS foldl", "list_reduce(list_reverse(a), lambda n, x: (n * 7 + x) % 1009, 1) AS foldr", "CAST(len(list_filter(a, lambda x: x > 45)) > 0 AS BIGINT) AS exists_", "CAST(len(list_filter(a, lambda x: x <= 10)) = 0 AS BIGINT) AS all_",
        JOINED("list_transform(range(len(a)), lambda i: i * i)", "tabulate"), "CAST(list_contains(a, 7) AS BIGINT) AS elem", "CAST(NOT list_contains(a, 7) AS BIGINT) AS notelem",
        "CASE WHEN a < b THEN 'LESS' WHEN a = b THEN 'EQUAL' ELSE 'GREATER' END AS collate_", "'' AS nil",
    ]
)


def elements(cls, a: Column, b: Column) -> dict[str, Column]:
    """The members that List, Bag and Vector share."""
    item, parts = cls.get_item(a), cls.partition(lambda x: x > 25, a)
    half = F.floor(F.size(a) / 2).cast("int")
    step = lambda x, n: (n * 7 + x) % 1009
    return {
        "null_": cls.null(a), "length": cls.length(a), "at": text(cls.at(a, b)), "hd": cls.hd(a), "tl": text(cls.tl(a)), "last": cls.last(a), "item_hd": item["_1"], "item_tl": text(item["_2"]), "nth": cls.nth(a, F.size(a) - 1), "only": cls.only(cls.take(a, 1)),
        "take": text(cls.take(a, half)), "drop": text(cls.drop(a, half)), "rev": text(cls.rev(a)), "concat": text(cls.concat(F.array(a, b))), "rev_append": text(cls.rev_append(a, b)),
        "map": text(cls.map(lambda x: x * 2 + 1, a)), "mapi": text(cls.mapi(lambda i, x: i + x, a)), "map_partial": text(cls.map_partial(lambda x: F.when(x > 25, x - 25), a)), "find": cls.find(lambda x: x > 25, a),
        "filter": text(cls.filter(lambda x: x > 25, a)), "part_1": text(parts["_1"]), "part_2": text(parts["_2"]), "foldl": cls.foldl(step, F.lit(1), a), "foldr": cls.foldr(step, F.lit(1), a), "exists_": cls.exists(lambda x: x > 45, a), "all_": cls.all(lambda x: x > 10, a),
        "tabulate": text(cls.tabulate(F.size(a), lambda i: i * i)), "elem": cls.elem(7, a), "notelem": cls.notelem(7, a), "collate_": cls.collate(Int.compare, a, b), "nil": text(cls.nil()),
    }


@compared("hd last item_hd nth only find foldl foldr", f"WITH t AS ({LISTS}) SELECT o_orderkey, {ELEMENTS} FROM t")
def q_lib_list(spark, d):
    return shown(lists(spark, d), ["o_orderkey"], elements(List, F.col("a"), F.col("b")))


@compared("hd last item_hd nth only find foldl foldr fold", f"WITH t AS ({LISTS}) SELECT o_orderkey, {ELEMENTS}, {JOINED('a', 'from_list')}, {JOINED('a', 'to_list')}, list_reduce(a, lambda n, x: n + x, 0) AS fold FROM t")
def q_lib_bag(spark, d):
    a = F.col("a")
    return shown(lists(spark, d), ["o_orderkey"], elements(Bag, a, F.col("b")) | {"from_list": text(Bag.from_list(a)), "to_list": text(Bag.to_list(a)), "fold": Bag.fold(lambda x, n: n + x, F.lit(0), a)})


@compared("hd last item_hd nth only find foldl foldr max_len sub foldli foldri", f"""WITH t AS ({LISTS}) SELECT o_orderkey, {ELEMENTS}, 16777215 AS max_len, {JOINED('a', 'from_list')}, a[len(a)] AS sub, {JOINED("list_transform(a, lambda x, i: CASE WHEN i = 1 THEN 99 ELSE x END)", "update_")}, list_sum(list_transform(a, lambda x, i: x * (i - 1))) AS foldli, list_sum(list_transform(a, lambda x, i: x * (i - 1))) AS foldri,
  list_filter(list_transform(a, lambda x, i: CASE WHEN x > 25 AND i > 1 THEN i - 1 END), lambda x: x IS NOT NULL)[1] AS findi FROM t""")
def q_lib_vector(spark, d):
    a = F.col("a")
    more = {
        "max_len": F.lit(Vector.max_len), "from_list": text(Vector.from_list(a)), "sub": Vector.sub(a, F.size(a) - 1), "update_": text(Vector.update(a, 0, F.lit(99))), "foldli": Vector.foldli(lambda i, x, n: n + i * x, F.lit(0), a), "foldri": Vector.foldri(lambda i, x, n: n + i * x, F.lit(0), a),
        "findi": Vector.findi(lambda i, x: (x > 25) & (i > 0), a)["_1"],
    }
    return shown(lists(spark, d), ["o_orderkey"], elements(Vector, a, F.col("b")) | more)


TIMES = lambda a, x: f"len(list_filter({a}, lambda y: y = {x}))"


@query(f"""WITH t AS ({LISTS}), u AS (SELECT o_orderkey, unnest(a) % 5 AS x, 'a' AS s FROM t UNION ALL SELECT o_orderkey, unnest(b) % 5, 'b' FROM t), n AS (SELECT o_orderkey, x, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb FROM u GROUP BY ALL)
  SELECT o_orderkey, CAST(sum(greatest(na - nb, 0)) AS BIGINT) AS except_n, CAST(sum(x * greatest(na - nb, 0)) AS BIGINT) AS except_sum, CAST(sum(least(na, nb)) AS BIGINT) AS intersect_n, CAST(sum(x * least(na, nb)) AS BIGINT) AS intersect_sum FROM n GROUP BY o_orderkey""")
def q_lib_list_sets(spark, d):
    mod5 = lambda c: F.transform(c, lambda x: x % 5)
    a, b = mod5(F.col("a")), mod5(F.col("b"))
    total = lambda c: List.foldl(lambda x, n: n + x, F.lit(0), c)
    gone, met = List.except_(a, b), List.intersect(a, b)
    return shown(lists(spark, d), ["o_orderkey"], {"except_n": F.size(gone), "except_sum": total(gone), "intersect_n": F.size(met), "intersect_sum": total(met)})


@compared("unequal", f"""WITH t AS ({LISTS}), z AS (SELECT o_orderkey, a, b, list_zip(a, b) AS p FROM t) SELECT o_orderkey, {JOINED("list_transform(p, lambda x: x[1] * 100 + x[2])", "zip")}, {JOINED("list_transform(p, lambda x: x[1] * 100 + x[2])", "zip_eq")}, {JOINED("a", "unzip_1")}, {JOINED("b", "unzip_2")}, {JOINED("list_transform(p, lambda x: x[1] - x[2])", "map")}, {JOINED("list_transform(p, lambda x: x[1] - x[2])", "map_eq")},
  CAST(len(list_filter(p, lambda x: x[1] <= x[2])) = 0 AS BIGINT) AS all_, CAST(len(list_filter(p, lambda x: x[1] <= x[2])) = 0 AS BIGINT) AS all_eq, 0 AS unequal, CAST(len(list_filter(p, lambda x: x[1] = x[2])) > 0 AS BIGINT) AS exists_,
  list_reduce(list_transform(p, lambda x: CAST(x[1] * x[2] AS BIGINT)), lambda n, x: (n * 3 + x) % 1009, 0) AS foldl, list_reduce(list_transform(p, lambda x: CAST(x[1] * x[2] AS BIGINT)), lambda n, x: (n * 3 + x) % 1009, 0) AS foldl_eq,
  list_reduce(list_reverse(list_transform(p, lambda x: CAST(x[1] * x[2] AS BIGINT))), lambda n, x: (n * 3 + x) % 1009, 0) AS foldr, list_reduce(list_reverse(list_transform(p, lambda x: CAST(x[1] * x[2] AS BIGINT))), lambda n, x: (n * 3 + x) % 1009, 0) AS foldr_eq FROM z""")
def q_lib_list_pair(spark, d):
    a, b = F.col("a"), F.col("b")
    coded = lambda p: text(F.transform(p, lambda x: x["_1"] * 100 + x["_2"]))
    step = lambda x, y, n: (n * 3 + x * y) % 1009
    both = ListPair.unzip(ListPair.zip(a, b))
    longer = F.concat(b, F.array(F.lit(0)))
    return shown(
        lists(spark, d),
        ["o_orderkey"],
        {
            "zip": coded(ListPair.zip(a, longer)), "zip_eq": coded(ListPair.zip_eq(a, b)), "unzip_1": text(both["_1"]), "unzip_2": text(both["_2"]), "map": text(ListPair.map(lambda x, y: x - y, a, longer)), "map_eq": text(ListPair.map_eq(lambda x, y: x - y, a, b)),
            "all_": ListPair.all(lambda x, y: x > y, a, longer), "all_eq": ListPair.all_eq(lambda x, y: x > y, a, b), "unequal": ListPair.all_eq(lambda x, y: x == x, a, longer), "exists_": ListPair.exists(lambda x, y: x == y, a, b),
            "foldl": ListPair.foldl(step, F.lit(0), a, longer), "foldl_eq": ListPair.foldl_eq(step, F.lit(0), a, b), "foldr": ListPair.foldr(step, F.lit(0), a, b), "foldr_eq": ListPair.foldr_eq(step, F.lit(0), a, b),
        },
    )


# ---------------------------------------------------------------- Option and Either


@compared("val_of filter_ join_ map map_partial compose compose_partial", """WITH t AS (SELECT o_orderkey, max(l_linenumber) FILTER (l_quantity > 40) AS x FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) SELECT o_orderkey, coalesce(x, 0) AS val_of, CASE WHEN x > 2 THEN x END AS filter_, x AS join_, x + 1 AS map, CASE WHEN x > 2 THEN x END AS map_partial, CASE WHEN x > 2 THEN x * 2 END AS compose, CASE WHEN x > 2 AND x < 5 THEN x END AS compose_partial FROM t""")
def q_lib_option(spark, d):
    lines = parquet(spark, d, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("x"))
    t = parquet(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "x")
    x = F.col("x")
    above = lambda v: F.when(v > 2, v)
    return shown(
        t,
        ["o_orderkey"],
        {
            "val_of": Option.val_of(F.coalesce(x, F.lit(0))), "filter_": Option.filter(lambda v: v > 2, x), "join_": Option.join(Option.nested(x)), "map": Option.map(lambda v: v + 1, x), "map_partial": Option.map_partial(above, x),
            "compose": Option.compose(lambda v: v * 2, above)(x), "compose_partial": Option.compose_partial(lambda v: F.when(v < 5, v), above)(x),
        },
    )


@compared("as_left as_right map map_left map_right fold", """WITH t AS (SELECT c_custkey, c_nationkey AS n, c_acctbal < 0 AS l FROM customer) SELECT c_custkey, CAST(l AS BIGINT) AS is_left, CAST(NOT l AS BIGINT) AS is_right, CASE WHEN l THEN n END AS as_left, CASE WHEN NOT l THEN n * 2 END AS as_right, CASE WHEN l THEN n + 1 ELSE n * 2 - 1 END AS map, CASE WHEN l THEN n + 1 ELSE n * 2 END AS map_left, CASE WHEN l THEN n ELSE n * 2 - 1 END AS map_right, CASE WHEN l THEN 10 + n ELSE 10 - n * 2 END AS fold, CAST(l AS BIGINT) + 1 AS part_1, 2 - CAST(l AS BIGINT) AS part_2 FROM t""")
def q_lib_either(spark, d):
    n = F.col("c_nationkey")
    e = F.when(F.col("c_acctbal") < 0, Either.inl(n)).otherwise(Either.inr(n * 2))
    up, down = lambda x: x + 1, lambda x: x - 1
    parts = Either.partition(F.array(e, Either.inl(n), Either.inr(n)))
    return shown(
        parquet(spark, d, "customer"),
        ["c_custkey"],
        {
            "is_left": Either.is_left(e), "is_right": Either.is_right(e), "as_left": Either.as_left(e), "as_right": Either.as_right(e), "map": Either.proj(Either.map(up, down, e)), "map_left": Either.proj(Either.map_left(up, e)), "map_right": Either.proj(Either.map_right(down, e)),
            "fold": Either.fold(lambda x, a: a + x, lambda x, a: a - x, F.lit(10), e), "part_1": F.size(parts["_1"]), "part_2": F.size(parts["_2"]),
        },
    )


# ---------------------------------------------------------------- Range


@query("""SELECT p_partkey, CAST(p_size BETWEEN 5 AND 9 AS BIGINT) AS closed, CAST(p_size > 5 AND p_size < 9 AS BIGINT) AS open_, CAST(p_size >= 5 AND p_size < 9 AS BIGINT) AS closed_open, CAST(p_size > 5 AND p_size <= 9 AS BIGINT) AS open_closed, CAST(p_size >= 5 AS BIGINT) AS at_least, CAST(p_size > 5 AS BIGINT) AS greater_than, CAST(p_size <= 5 AS BIGINT) AS at_most, CAST(p_size < 5 AS BIGINT) AS less_than, CAST(p_size = 5 AS BIGINT) AS point,
  CAST(p_size BETWEEN 5 AND 12 OR p_size > 40 AS BIGINT) AS discrete, CAST(NOT (p_size BETWEEN 5 AND 12 OR p_size > 40) AS BIGINT) AS complement, CAST(p_size BETWEEN 5 AND 12 OR p_size > 40 AS BIGINT) AS ranges, '1,2,3,3,4' AS flatten_ FROM part""")
def q_lib_range(spark, d):
    x = F.col("p_size")
    one = {"closed": Range.closed(5, 9), "open_": Range.open(5, 9), "closed_open": Range.closed_open(5, 9), "open_closed": Range.open_closed(5, 9), "at_least": Range.at_least(5), "greater_than": Range.greater_than(5), "at_most": Range.at_most(5), "less_than": Range.less_than(5), "point": Range.point(5)}
    s = RangeSet.discrete_of([Range.closed(5, 8), Range.closed(9, 12), Range.greater_than(40)])
    any_ = F.lit(False)
    for r in s.ranges:
        any_ = any_ | r.contains(x)
    return shown(parquet(spark, d, "part"), ["p_partkey"], {n: r.contains(x) for n, r in one.items()} | {"discrete": s.contains(x), "complement": s.complement().contains(x), "ranges": any_, "flatten_": text(flatten([Range.closed(1, 3), Range.open(2, 5)]))})


@query("SELECT i AS value, n_name FROM range(0, 12) r(i) JOIN nation ON n_nationkey = i WHERE i BETWEEN 1 AND 4 OR i BETWEEN 8 AND 10")
def q_lib_range_scan(spark, d):
    """A finite set of ranges as a relation."""
    s = RangeSet.discrete_of([Range.closed(1, 2), Range.open(2, 5), Range.closed_open(8, 11)])
    n = parquet(spark, d, "nation")
    halves = s.to_list(spark).where("value < 5").unionByName(s.to_bag(spark).where("value > 5"))
    return halves.join(n, F.col("value") == F.col("n_nationkey")).select("value", "n_name")


# ---------------------------------------------------------------- Date and Time


@compared("local_offset", """WITH t AS (SELECT event_id, ts, epoch_us(ts) AS us FROM events) SELECT event_id, minute(ts) AS "minute", second(ts) AS "second", strftime(ts, '%a %b %d %H:%M:%S %Y') AS to_string, strftime(ts, '%Y/%j %H.%M.%S %y %p %I') AS fmt, CAST(us AS BIGINT) * 1000 AS to_time, us * 1000 AS from_time_univ, us * 1000 AS from_time_local,
  us // 1000000 * 1000000000 AS from_string, us // 1000000 * 1000000000 AS scanned, ' x' AS rest, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'LESS' WHEN ts = TIMESTAMP '2024-01-15' THEN 'EQUAL' ELSE 'GREATER' END AS compare, epoch_us(date_trunc('day', ts)) * 1000 AS built, CAST(NULL AS BIGINT) AS is_dst, CAST(NULL AS BIGINT) AS offset_, 0 AS local_offset FROM t""")
def q_lib_date(spark, d):
    ts = F.col("ts").cast("timestamp")
    e = Date.of(ts)
    scanned = Date.scan(F.concat(F.lit(" "), Date.to_string(e), F.lit(" x")))
    ns = lambda c: F.unix_micros(c["ts"]) * 1000
    time = F.unix_micros(ts) * 1000
    built = Date.date(Date.year(e), F.lit(1), Date.year_day(e) + 1)
    return shown(
        parquet(spark, d, "events"),
        ["event_id"],
        {
            "minute": Date.minute(e), "second": Date.second(e), "to_string": Date.to_string(e), "fmt": Date.fmt("%Y/%j %H.%M.%S %y %p %I", e), "to_time": Date.to_time(e), "from_time_univ": ns(Date.from_time_univ(time)), "from_time_local": ns(Date.from_time_local(time)),
            "from_string": ns(Date.from_string(Date.to_string(e))), "scanned": ns(scanned["_1"]), "rest": scanned["_2"], "compare": Date.compare(e, Date.of(F.lit("2024-01-15 00:00:00"))), "built": ns(built), "is_dst": Date.is_dst(e), "offset_": Date.offset(e), "local_offset": Date.local_offset(),
        },
    )


@compared("zero_time now", """WITH t AS (SELECT event_id, event_id * 1500000001 - 4000000000 AS n FROM events), v AS (SELECT *, CASE WHEN n < 0 THEN '~' ELSE '' END AS m, abs(n) AS p FROM t) SELECT event_id, CAST(trunc(CAST(n AS DECIMAL(38, 0)) / 1000000) AS BIGINT) AS to_milliseconds, CAST(trunc(CAST(n AS DECIMAL(38, 0)) / 1000) AS BIGINT) AS to_microseconds, n AS to_nanoseconds, event_id * 1000000000 AS from_seconds, event_id * 1000 AS from_microseconds, event_id AS from_nanoseconds,
  n + event_id AS "add", n - event_id AS sub, CASE WHEN n < 0 THEN 'LESS' WHEN n = 0 THEN 'EQUAL' ELSE 'GREATER' END AS compare, CAST(n < 0 AS BIGINT) AS lt, CAST(n <= 0 AS BIGINT) AS le, CAST(n > 0 AS BIGINT) AS gt, CAST(n >= 0 AS BIGINT) AS ge, m || (p // 1000000000) || '.' || lpad(CAST(p % 1000000000 AS VARCHAR), 9, '0') AS fmt, n AS from_string, n AS scanned, 's' AS rest,
  m || (p // 1000000000) || '.' || lpad(CAST(p % 1000000000 // 1000000 AS VARCHAR), 3, '0') AS to_string, event_id * 125000000 AS from_real, CAST(CAST(event_id AS FLOAT) AS DOUBLE) AS to_real, 0 AS zero_time, 1 AS now FROM v""")
def q_lib_time(spark, d):
    k = F.col("event_id")
    n = k * 1500000001 - 4000000000
    scanned = Time.scan(F.concat(F.lit(" "), Time.fmt(9, n), F.lit("s")))
    two = {c: getattr(Time, c)(n, F.lit(Time.zero_time).cast("long")) for c in ("compare", "lt", "le", "gt", "ge")}
    whole = n - n % 1000000  # a time is written rounded
    more = {
        "to_milliseconds": Time.to_milliseconds(n), "to_microseconds": Time.to_microseconds(n), "to_nanoseconds": Time.to_nanoseconds(n), "from_seconds": Time.from_seconds(k), "from_microseconds": Time.from_microseconds(k), "from_nanoseconds": Time.from_nanoseconds(k), "add": Time.add(n, k), "sub": Time.sub(n, k),
        "fmt": Time.fmt(9, n), "from_string": Time.from_string(Time.fmt(9, n)), "scanned": scanned["_1"], "rest": scanned["_2"], "to_string": Time.to_string(whole), "from_real": Time.from_real((k.cast("float") / 8).cast("float")), "to_real": Time.to_real(Time.from_seconds(k)), "zero_time": F.lit(Time.zero_time), "now": Time.now() > 0,
    }
    return shown(parquet(spark, d, "events"), ["event_id"], two | more)


# ---------------------------------------------------------------- Fn, General, Relational


@compared("n_nationkey id const apply o curry uncurry flip repeat general_o before", """SELECT n_nationkey, n_nationkey AS id, 7 AS const, n_nationkey + 1 AS apply, (n_nationkey + 1) * 2 AS o, n_nationkey - n_regionkey AS curry, n_nationkey - n_regionkey AS uncurry, n_regionkey - n_nationkey AS flip, n_nationkey * 8 AS repeat, CAST(n_nationkey = n_regionkey AS BIGINT) AS equal, CAST(n_nationkey <> n_regionkey AS BIGINT) AS not_equal, (n_nationkey * 2) + 1 AS general_o, n_nationkey AS before,
  CASE WHEN n_nationkey < n_regionkey THEN 'LESS' WHEN n_nationkey = n_regionkey THEN 'EQUAL' ELSE 'GREATER' END AS compare FROM nation""")
def q_lib_fn(spark, d):
    a, b = F.col("n_nationkey"), F.col("n_regionkey")
    minus = lambda p: p[0] - p[1]
    up, twice = lambda x: x + 1, lambda x: x * 2
    General.ignore(a)
    return shown(
        parquet(spark, d, "nation"),
        ["n_nationkey"],
        {
            "id": Fn.id(a), "const": F.lit(Fn.const(7)(a)), "apply": Fn.apply(up, a), "o": Fn.o(twice, up)(a), "curry": Fn.curry(minus)(a)(b), "uncurry": Fn.uncurry(lambda x: lambda y: x - y)((a, b)), "flip": Fn.flip(minus)((a, b)), "repeat": Fn.repeat(3, twice)(a),
            "equal": Fn.equal(a, b), "not_equal": Fn.not_equal(a, b), "general_o": General.o(up, twice)(a), "before": General.before(a, None), "compare": Relational.compare(a, b),
        },
    )


@compared("n_nationkey only", "WITH t AS (SELECT c_nationkey AS k, c_acctbal AS x FROM customer) SELECT n_nationkey, CAST(count(k) = 0 AS BIGINT) AS empty, CAST(count(k) > 0 AS BIGINT) AS non_empty, min(n_regionkey) AS only FROM nation LEFT JOIN t ON k = n_nationkey AND x < -800 GROUP BY n_nationkey")
def q_lib_relational(spark, d):
    """empty, nonEmpty and only over each nation's customers in debt."""
    from tessera.operators import aggregates as agg

    poor = parquet(spark, d, "customer").where("c_acctbal < -800")
    nations = parquet(spark, d, "nation")
    groups = poor.groupBy("c_nationkey").agg(agg.empty().alias("e"), agg.non_empty().alias("n"))
    single = nations.groupBy("n_nationkey").agg(agg.only(F.col("n_regionkey")).alias("only"))
    both = single.join(groups, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return shown(both.withColumnRenamed("only", "o"), ["n_nationkey"], {"empty": F.coalesce("e", F.lit(True)), "non_empty": F.coalesce("n", F.lit(False)), "only": F.col("o")})


# ---------------------------------------------------------------- members of the driver, over the 25 nations


def nation_rows(spark, d) -> list:
    """The table of nations has 25 rows at any scale."""
    return parquet(spark, d, "nation").orderBy("n_nationkey").limit(100).collect()


@compared("n_nationkey vector_appi", "SELECT n_nationkey, n_name AS list_app, n_name AS bag_app, n_name AS vector_app, n_nationkey * 100 + n_regionkey AS vector_appi, n_name || n_regionkey AS pair_app, n_name || n_regionkey AS pair_app_eq, CASE WHEN n_regionkey > 1 THEN n_name END AS option_app, CASE WHEN n_regionkey > 1 THEN 'l' ELSE 'r' END || n_name AS either_app, CASE WHEN n_regionkey > 1 THEN n_name END AS app_left, CASE WHEN n_regionkey <= 1 THEN n_name END AS app_right FROM nation")
def q_lib_app(spark, d):
    """What the effects of app have written down, in order."""
    rows = nation_rows(spark, d)
    names, regions = [r.n_name for r in rows], [r.n_regionkey for r in rows]
    seen: dict[str, list] = {n: [] for n in ("list_app", "bag_app", "vector_app", "vector_appi", "pair_app", "pair_app_eq", "option_app", "either_app", "app_left", "app_right")}
    List.app(seen["list_app"].append, names)
    Bag.app(seen["bag_app"].append, names)
    Vector.app(seen["vector_app"].append, names)
    Vector.appi(lambda i, r: seen["vector_appi"].append(i * 100 + r), regions)
    ListPair.app(lambda n, r: seen["pair_app"].append(f"{n}{r}"), names, regions)
    ListPair.app_eq(lambda n, r: seen["pair_app_eq"].append(f"{n}{r}"), names, regions)
    for n, r in zip(names, regions, strict=True):
        tag = 0 if r > 1 else 1
        for member, run in (
            ("option_app", lambda f: Option.app(f, n if r > 1 else None)), ("either_app", lambda f: Either.app(lambda x: f(f"l{x}"), lambda x: f(f"r{x}"), tag, n)),
            ("app_left", lambda f: Either.app_left(f, tag, n)), ("app_right", lambda f: Either.app_right(f, tag, n)),
        ):
            got: list = []
            run(got.append)
            seen[member].append(got[0] if got else None)
    out = [(r.n_nationkey, *(seen[m][i] for m in seen)) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, "n_nationkey bigint, " + ", ".join(f"{m} {'bigint' if m == 'vector_appi' else 'string'}" for m in seen))


DASHED = "replace(n_name, ' ', '-')"


@compared("n_nationkey", f"""WITH t AS (SELECT n_nationkey, {DASHED} AS n, CAST(n_regionkey AS VARCHAR) AS r FROM nation) SELECT n_nationkey, n || ' ' || r AS hsep, n || r AS hcat, n || chr(10) || r AS vsep, n || chr(10) || r AS vcat, n || ' ' || r AS sep_flat, n || chr(10) || r AS sep_broken, n || r AS cat_flat, n || chr(10) || r AS cat_broken, n || ' ' || r AS fill_sep, n || r AS fill_cat,
  '(' || n || ')' AS parens, '{{' || n || '}}' AS braces, '[' || n || ']' AS brackets, '[' || n || ',' || r || ']' AS enclose_sep, n || ', ' || r AS punctuate, '  ' || n || chr(10) || '  ' || r AS indent, n || chr(10) || '    ' || r AS hang, 'x ' || n || chr(10) || '  ' || r AS align, n || chr(10) || '   ' || r AS nest, n || chr(10) || r AS hard_line,
  n || ' ' || r AS soft_line, n || r AS soft_break, n || r AS line_break, n || chr(10) || r AS line, n AS empty, n || r AS beside, n || ' ' || r AS "group" FROM t""")
def q_lib_pretty(spark, d):
    """Documents of each nation's name and region, laid out."""
    from tessera.functions import pretty as pp

    def laid_out(r) -> tuple:
        n, k = pp.text(r.n_name.replace(" ", "-")), pp.text(str(r.n_regionkey))
        two, wide, narrow = [n, k], 80, 2
        docs = [
            (wide, pp.hsep(two)), (wide, pp.hcat(two)), (wide, pp.vsep(two)), (wide, pp.vcat(two)), (wide, pp.sep(two)), (narrow, pp.sep(two)), (wide, pp.cat(two)), (narrow, pp.cat(two)), (wide, pp.fill_sep(two)), (wide, pp.fill_cat(two)),
            (wide, pp.parens(n)), (wide, pp.braces(n)), (wide, pp.brackets(n)), (wide, pp.enclose_sep(pp.text("["), pp.text("]"), pp.text(","), two)), (wide, pp.hsep(pp.punctuate(pp.text(","), two))), (wide, pp.indent(2, pp.vsep(two))), (wide, pp.hang(4, pp.vsep(two))), (wide, pp.beside(pp.text("x "), pp.align(pp.vsep(two)))),
            (wide, pp.nest(3, pp.vsep(two))), (wide, pp.group(pp.beside(n, pp.beside(pp.hard_line, k)))), (wide, pp.beside(n, pp.beside(pp.soft_line, k))), (wide, pp.beside(n, pp.beside(pp.soft_break, k))), (wide, pp.group(pp.beside(n, pp.beside(pp.line_break, k)))), (wide, pp.beside(n, pp.beside(pp.line, k))),
            (wide, pp.beside(pp.empty, n)), (wide, pp.beside(n, k)), (wide, pp.group(pp.beside(n, pp.beside(pp.line, k)))),
        ]
        return (r.n_nationkey, *(pp.render(w, x) for w, x in docs))

    names = "hsep hcat vsep vcat sep_flat sep_broken cat_flat cat_broken fill_sep fill_cat parens braces brackets enclose_sep punctuate indent hang align nest hard_line soft_line soft_break line_break line empty beside group".split()
    return spark.createDataFrame([laid_out(r) for r in nation_rows(spark, d)], "n_nationkey bigint, " + ", ".join(f"`{n}` string" for n in names))


@compared("n_nationkey same", """SELECT n_nationkey, 'RECORD [("key", INT ' || n_nationkey || '), ("name", STRING "' || n_name || '"), ("none", VARIANT_NONE), ("tags", LIST [BOOL ' || CASE WHEN n_regionkey > 2 THEN 'true' ELSE 'false' END || ', VARIANT_SOME (INT ~' || (n_regionkey + 1) || ')])]' AS printed, 1 AS same FROM nation""")
def q_lib_variant(spark, d):
    """Rows as variants, printed, and read back."""
    from tessera.functions.variant import Variant, of, parse, print_

    out = []
    for r in nation_rows(spark, d):
        tags = Variant("LIST", (of(r.n_regionkey > 2), Variant("VARIANT_SOME", of(-(r.n_regionkey + 1)))))
        v = Variant("RECORD", (("key", of(r.n_nationkey)), ("name", of(r.n_name)), ("none", of(None)), ("tags", tags)))
        out.append((r.n_nationkey, print_(v), int(parse(print_(v)) == v)))
    return spark.createDataFrame(out, "n_nationkey bigint, printed string, same bigint")


@compared("n_nationkey unset planned parsed", "SELECT n_nationkey, n_name, 'wide' AS shown, 'a=1;mode=wide' AS shown_all, 0 AS unset, 'it,nation,twice' AS env, 'nation' AS cleared, 1 AS planned, 1 AS parsed FROM nation WHERE n_regionkey * 2 > 3")
def q_lib_session(spark, d):
    """A session's functions: properties, the environment, a file of statements, the plan of its query."""
    from pathlib import Path

    from tessera.operators.rel import Rel
    from tessera.plans.lang import Session

    s = Session(spark, {"nation": Rel.bag(parquet(spark, d, "nation"), "n")})
    s.set("mode", "wide")
    s.set("a", 1)
    s.set("gone", 2)
    s.unset("gone")
    rows = s.use(str(Path(__file__).with_name("statements.sml"))).result()
    planned, env = "Scan parquet" in s.plan(), ",".join(s.names())
    parsed = "query" in s.parse_tree("from n in nation;")
    s.clear_env()
    facts = {"shown": s.show("mode"), "shown_all": ";".join(f"{k}={v}" for k, v in s.show_all()), "unset": int(s.show("gone") is not None), "env": env, "cleared": ",".join(s.names()), "planned": int(planned), "parsed": int(parsed)}
    return rows.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", *(F.lit(v).cast("bigint" if isinstance(v, int) else "string").alias(k) for k, v in facts.items()))


@compared("r refused translated", "SELECT DISTINCT n_regionkey AS r, '{far:{n:int, r:int} list}' AS validated, 1 AS refused, 1 AS translated FROM nation WHERE n_nationkey > 20")
def q_lib_datalog_text(spark, d):
    """A program's type, what is wrong with another, and its plans."""
    from tessera.plans import datalog

    nations = parquet(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    program = ".decl nation(n:int, r:int)\n.decl far(n:int, r:int)\nfar(N, R) :- nation(N, R), N > 20.\n.output far\n"
    refused = datalog.validate(".decl p(x:int)\np(X) :- q(X).\n.output p\n")
    plans = datalog.translate(spark, program, {"nation": nations})
    found = datalog.execute(spark, program, {"nation": nations})["far"]
    return found.select(F.col("r").cast("bigint").alias("r"), F.lit(datalog.validate(program)).alias("validated"), F.lit(int(not refused.startswith("{"))).cast("bigint").alias("refused"), F.lit(int("-- far" in (plans or ""))).cast("bigint").alias("translated")).distinct()


@compared("n_nationkey exn_message", """SELECT n_nationkey, 'Empty' AS exn_name, 1 AS exn_message FROM nation""")
def q_lib_exceptions(spark, d):
    """The name and the message of what a plan raises."""
    nations = parquet(spark, d, "nation")
    try:
        nations.select(List.hd(F.filter(F.array("n_nationkey"), lambda x: x < 0))).collect()
        name, told = "none", 0
    except Exception as e:  # noqa: BLE001
        name, told = General.exn_name(e), int("Empty" in General.exn_message(e))
    return nations.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.lit(name).alias("exn_name"), F.lit(told).cast("bigint").alias("exn_message"))
