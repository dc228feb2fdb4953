"""Values of library members, each evaluated by Spark."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.collections import Bag, Either, List, ListPair, Option, Vector
from tessera.functions.general import Fn, General
from tessera.functions.numbers import Bool, Int, Math, Real, Word
from tessera.functions.ranges import Range, RangeSet, flatten
from tessera.functions.strings import Char, String, StringCvt
from tessera.functions.times import Date, Time

A = lambda *xs: F.array(*map(F.lit, xs))
L = F.lit
none = lambda: F.lit(None).cast("int")

CASES = {
    "Int.div": (lambda: Int.div(L(-7), L(2)), -4),
    "Int.mod": (lambda: Int.mod(L(7), L(-3)), -2),
    "Int.quot": (lambda: Int.quot(L(-7), L(2)), -3),
    "Int.rem": (lambda: Int.rem(L(-7), L(2)), -1),
    "Int.compare": (lambda: Int.compare(L(1), L(2)), "LESS"),
    "Int.toString": (lambda: Int.to_string(L(-12)), "~12"),
    "Int.fmt": (lambda: Int.fmt("HEX", L(-255)), "~FF"),
    "Int.fromString": (lambda: Int.from_string(L("  ~42abc")), -42),
    "Int.fromString none": (lambda: Int.from_string(L("x")), None),
    "Int.scan": (lambda: Int.scan("HEX", L("0x1Fz")), (31, "z")),
    "Int.sameSign": (lambda: Int.same_sign(L(-1), L(-5)), True),
    "Real./0": (lambda: Real.div(L(1.0), L(0.0)), math.inf),
    "Real.-/0": (lambda: Real.div(L(-1.0), L(0.0)), -math.inf),
    "Real.=nan": (lambda: Real.eq(L(float("nan")), L(float("nan"))), False),
    "Real.<nan": (lambda: Real.lt(L(1.0), L(float("nan"))), False),
    "Real.round": (lambda: Real.round(L(2.5)), 2),
    "Real.floor": (lambda: Real.floor(L(-2.5)), -3),
    "Real.trunc": (lambda: Real.trunc(L(-2.5)), -2),
    "Real.toString": (lambda: Real.to_string(L(-1.5)), "~1.5"),
    "Real.toString whole": (lambda: Real.to_string(L(10.0)), "10"),
    "Real.toString exponent": (lambda: Real.to_string(L(1e10)), "1E10"),
    "Real.toString small": (lambda: Real.to_string(L(1.5e-5)), "1.5E~5"),
    "Real.toString inf": (lambda: Real.to_string(L(-math.inf)), "~inf"),
    "Real.fmt FIX": (lambda: Real.fmt("FIX", L(-3.14159), 2), "~3.14"),
    "Real.fmt SCI": (lambda: Real.fmt("SCI", L(12345.678), 3), "1.235E4"),
    "Real.fromString": (lambda: Real.from_string(L(" ~1.5e2x")), -150.0),
    "Real.toManExp": (lambda: Real.to_man_exp(L(8.0)), (4, 0.5)),
    "Real.split": (lambda: Real.split(L(-2.5)), (-0.5, -2.0)),
    "Real.signBit": (lambda: Real.sign_bit(L(-0.0)), True),
    "Real.min nan": (lambda: Real.min(L(float("nan")), L(1.0)), 1.0),
    "Word.-": (lambda: Word.sub(L(0), L(1)), -1),
    "Word.*": (lambda: Word.mul(L(-1), L(-1)), 1),
    "Word.* wide": (lambda: Word.mul(L(0x123456789ABCDEF), L(0xFEDCBA987)), ((0x123456789ABCDEF * 0xFEDCBA987 + 2**63) % 2**64) - 2**63),
    "Word.div": (lambda: Word.div(L(-1), L(2)), 2**63 - 1),
    "Word.mod": (lambda: Word.mod(L(-1), L(10)), (2**64 - 1) % 10),
    "Word.<": (lambda: Word.lt(L(1), L(-1)), True),
    "Word.>>": (lambda: Word.shr(L(-1), L(60)), 15),
    "Word.~>>": (lambda: Word.sar(L(-16), L(2)), -4),
    "Word.<< beyond": (lambda: Word.shl(L(1), L(64)), 0),
    "Word.toString": (lambda: Word.to_string(L(255)), "FF"),
    "Word.fromString": (lambda: Word.from_string(L("0wxFF")), 255),
    "Math.sqrt": (lambda: Math.sqrt(L(16)), 4.0),
    "Math.ln 0": (lambda: Math.ln(L(0.0)), -math.inf),
    "Math.pow": (lambda: Math.pow(L(2.0), L(10.0)), 1024.0),
    "Bool.implies": (lambda: Bool.implies(L(False), L(False)), True),
    "Bool.fromString": (lambda: Bool.from_string(L(" TRUEish")), True),
    "Char.toUpper": (lambda: Char.to_upper(L("a")), "A"),
    "Char.isPunct": (lambda: Char.is_punct(L("[")), True),
    "Char.succ": (lambda: Char.succ(L("a")), "b"),
    "Char.toString": (lambda: Char.to_string(L("\n")), "\\n"),
    "Char.toString control": (lambda: Char.to_string(L("\x01")), "\\^A"),
    "Char.fromString": (lambda: Char.from_string(L("\\065")), "A"),
    "Char.toCString": (lambda: Char.to_c_string(L("\x01")), "\\001"),
    "String.substring": (lambda: String.substring(L("hello"), 1, 3), "ell"),
    "String.extract": (lambda: String.extract(L("hello"), 2), "llo"),
    "String.tokens": (lambda: String.tokens(lambda c: c == ",", L("a,,b")), ["a", "b"]),
    "String.fields": (lambda: String.fields(lambda c: c == ",", L("a,,b")), ["a", "", "b"]),
    "String.translate": (lambda: String.translate(lambda c: F.concat(c, c), L("ab")), "aabb"),
    "String.isPrefix": (lambda: String.is_prefix("he", L("hello")), True),
    "String.collate": (lambda: String.collate(Char.compare, L("ab"), L("b")), "LESS"),
    "String.toString": (lambda: String.to_string(L('a"\n')), 'a\\"\\n'),
    "String.fromString": (lambda: String.from_string(L("a\\tb")), "a\tb"),
    "String.concatWith": (lambda: String.concat_with(", ", A("a", "b")), "a, b"),
    "StringCvt.padLeft": (lambda: StringCvt.pad_left("0", 5, L("42")), "00042"),
    "StringCvt.padRight long": (lambda: StringCvt.pad_right(" ", 2, L("abc")), "abc"),
    "StringCvt.splitl": (lambda: StringCvt.splitl(Char.is_digit, L("12ab")), ("12", "ab")),
    "StringCvt.dropl": (lambda: StringCvt.dropl(Char.is_digit, L("12")), ""),
    "List.hd": (lambda: List.hd(A(1, 2)), 1),
    "List.tl": (lambda: List.tl(A(1, 2, 3)), [2, 3]),
    "List.getItem": (lambda: List.get_item(A(1, 2)), (1, [2])),
    "List.take": (lambda: List.take(A(1, 2, 3), 2), [1, 2]),
    "List.drop": (lambda: List.drop(A(1, 2, 3), 2), [3]),
    "List.revAppend": (lambda: List.rev_append(A(1, 2), A(3)), [2, 1, 3]),
    "List.mapPartial": (lambda: List.map_partial(lambda x: F.when(x > 1, x * 2), A(1, 2, 3)), [4, 6]),
    "List.find none": (lambda: List.find(lambda x: x > 9, A(1)), None),
    "List.partition": (lambda: List.partition(lambda x: x > 1, A(1, 2)), ([2], [1])),
    "List.foldl": (lambda: List.foldl(lambda x, n: n * 10 + x, 0, A(1, 2, 3)), 123),
    "List.foldr": (lambda: List.foldr(lambda x, n: n * 10 + x, 0, A(1, 2, 3)), 321),
    "List.tabulate": (lambda: List.tabulate(3, lambda i: i * i), [0, 1, 4]),
    "List.tabulate 0": (lambda: List.tabulate(0, lambda i: i), []),
    "List.collate": (lambda: List.collate(Int.compare, A(1, 2), A(1, 2, 0)), "LESS"),
    "List.except": (lambda: List.except_(A(2, 1, 2, 2, 3), A(2, 4)), [1, 2, 2, 3]),
    "List.intersect": (lambda: List.intersect(A(2, 1, 2, 2), A(2, 2, 4)), [2, 2]),
    "List.mapi": (lambda: List.mapi(lambda i, x: i + x, A(5, 5)), [5, 6]),
    "Bag.length": (lambda: Bag.length(A(1, 1)), 2),
    "Vector.update": (lambda: Vector.update(A(1, 2, 3), 1, L(9)), [1, 9, 3]),
    "Vector.foldli": (lambda: Vector.foldli(lambda i, x, n: n + i * x, 0, A(5, 6)), 6),
    "Vector.findi": (lambda: Vector.findi(lambda i, x: x > 5, A(5, 6)), (1, 6)),
    "ListPair.zip": (lambda: ListPair.zip(A(1, 2, 3), A("a", "b")), [(1, "a"), (2, "b")]),
    "ListPair.map": (lambda: ListPair.map(lambda x, y: x + y, A(1, 2), A(3, 4)), [4, 6]),
    "ListPair.allEq": (lambda: ListPair.all_eq(lambda x, y: x == y, A(1), A(1, 2)), False),
    "Option.getOpt": (lambda: Option.get_opt(none(), 3), 3),
    "Option.map": (lambda: Option.map(lambda x: x + 1, none()), None),
    "Option.filter": (lambda: Option.filter(lambda x: x > 2, 1), None),
    "Either.proj": (lambda: Either.proj(Either.inl(1)), 1),
    "Either.fold": (lambda: Either.fold(lambda x, n: n + x, lambda x, n: n - x, 10, Either.inr(3)), 7),
    "Range.flatten": (lambda: flatten([Range.closed(1, 3), Range.open(3, 5)]), [1, 2, 3, 4]),
    "Range.contains": (lambda: Range.closed_open(1, 3).contains(L(3)), False),
    "Time.toString": (lambda: Time.to_string(Time.from_milliseconds(L(-1500))), "~1.500"),
    "Time.toSeconds": (lambda: Time.to_seconds(Time.from_milliseconds(L(-1500))), -1),
    "Time.fromString": (lambda: Time.from_string(L("2.25s")), 2_250_000_000),
    "Date.date carries": (lambda: Date.fmt("%Y-%m-%d", Date.date(L(2021), L(3), L(32))), "2021-04-01"),
    "Date.fmt text": (lambda: Date.fmt("on %d of %b", Date.date(L(2021), L(3), L(2))), "on 02 of Mar"),
    "Date.weekDay": (lambda: Date.week_day(Date.date(L(2021), L(3), L(1))), 0),
    "Date.yearDay": (lambda: Date.year_day(Date.date(L(2021), L(1), L(1))), 0),
    "Fn.equal": (lambda: Fn.equal(none(), none()), True),
}


def plain(x):
    if isinstance(x, list):
        return [plain(v) for v in x]
    return tuple(map(plain, x)) if isinstance(x, tuple) else x


@pytest.mark.parametrize("name", CASES)
def test_member(spark, name):
    make, wanted = CASES[name]
    assert plain(spark.range(1).select(make().alias("v")).first()[0]) == wanted


@pytest.mark.parametrize(
    "make, error",
    [
        (lambda: List.hd(F.array().cast("array<int>")), "Empty"),
        (lambda: List.nth(A(1), 1), "Subscript"),
        (lambda: List.take(A(1), 2), "Subscript"),
        (lambda: List.tabulate(-1, lambda i: i), "Size"),
        (lambda: List.only(A(1, 2)), "Size"),
        (lambda: Option.val_of(none()), "Option"),
        (lambda: Char.chr(256), "Chr"),
        (lambda: Int.div(L(1), L(0)), "Div"),
        (lambda: Int.from_string(L("99999999999")), "Overflow"),
        (lambda: Real.floor(L(1e20)), "Overflow"),
        (lambda: ListPair.zip_eq(A(1), A(1, 2)), "UnequalLengths"),
        (lambda: String.sub(L("a"), 1), "Subscript"),
    ],
)
def test_raises(spark, make, error):
    with pytest.raises(Exception, match=error) as e:
        spark.range(1).select(make().alias("v")).first()
    assert error in str(e.value) and General.exn_message(e.value)


def test_range_sets(spark):
    s = RangeSet.continuous([Range.closed(1, 3), Range.open_closed(3, 5), Range.closed(8, 9)])
    assert s.ranges == (Range.closed(1, 5), Range.closed(8, 9))
    assert s.complement().ranges == (Range.less_than(1), Range.open(5, 8), Range.greater_than(9))
    assert s.complement().complement() == s
    d = RangeSet.discrete_of([Range.closed(1, 2), Range.closed(3, 4)])
    assert d.ranges == (Range.closed(1, 4),) and [r[0] for r in d.to_list(spark).collect()] == [1, 2, 3, 4]


def test_combinators():
    assert Fn.repeat(3, lambda x: x * 2)(1) == 8 and Fn.o(lambda x: x + 1, lambda x: x * 2)(5) == 11
    assert Fn.curry(lambda p: p[0] - p[1])(5)(3) == 2 and Fn.uncurry(lambda x: lambda y: x - y)((5, 3)) == 2
    assert Fn.flip(lambda p: p[0] - p[1])((5, 3)) == -2 and Fn.const(1)(2) == 1 and General.before(1, None) == 1


def test_words_of_large_keys_wrap(spark, tmp_path):
    """From o_custkey 848326 on a product leaves 64 bits."""
    pairs = [(149_999, 848_325), (7, 848_326), (8_999_999, 899_999), (53_999_999, 5_399_999)]
    spark.createDataFrame(pairs, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    from tessera.plans.library import q_lib_word

    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    found = {r.o_orderkey: r for r in q_lib_word(spark, str(tmp_path)).collect()}
    for key, customer in pairs:
        a, b = (key * 2654435761 - customer * 40503 * 65536 * 4096) % 2**64, customer * 97 - 5000
        r = found[key]
        assert (r.to_large, r.add, r.sub, r.mul, r.div, r.mod) == tuple(map(signed, (a, a + b, a - b, a * b, a // b, a % b)))
        assert (r.scanned, r.rest, r.from_string) == (key, "z", key)


def test_long_strings_are_escaped_by_runs(spark):
    """Plain characters aren't taken one by one, which a long string doesn't survive."""
    long = "plain text, " * 4000
    hard = long + '"\n' + long + "\\"
    one = spark.createDataFrame([(hard,)], "s string")
    for to, back in ((String.to_string, String.from_string), (String.to_c_string, String.from_c_string)):
        shown, read = one.select(to(F.col("s")), back(to(F.col("s")))).first()
        assert shown == long + '\\"\\n' + long + "\\\\" and read == hard
    assert one.select(String.scan(F.concat(String.to_string(F.col("s")), F.lit("\\q"))).alias("x")).select("x._2").first()[0] == "\\q"


def test_an_int_is_searched_for_once(spark):
    df = spark.createDataFrame([("7f",)], "s string")
    for scanned in (Int.scan("HEX", F.col("s"))["_1"], Int.from_string(F.col("s"))):
        plan = df.select(scanned.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract") <= 2 and plan.count("as int") <= 2
