"""Int, Real, Word, Math and Bool over columns.

int is IntegerType under ANSI arithmetic, so overflow raises. real is single precision: operations are
done in double and rounded. word is 64 unsigned bits kept in a LongType.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.base import EQUAL, GREATER, LESS, bound, col, order, raises

SPACE = r"^[ \t\n\x0B\f\r]*"
RADIX = {"BIN": 2, "OCT": 8, "DEC": 10, "HEX": 16}


def tilde(x: Column) -> Column:
    """A minus sign is written ~."""
    return F.replace(x, F.lit("-"), F.lit("~"))


def shared_comparisons(cls):
    cls.lt = staticmethod(lambda a, b: col(a) < col(b))
    cls.le = staticmethod(lambda a, b: col(a) <= col(b))
    cls.gt = staticmethod(lambda a, b: col(a) > col(b))
    cls.ge = staticmethod(lambda a, b: col(a) >= col(b))
    cls.compare = staticmethod(order)
    return cls


@shared_comparisons
class Int:
    precision, min_int, max_int = 32, -(2**31), 2**31 - 1

    @staticmethod
    def of(x) -> Column:
        return col(x).cast("int")

    to_large = from_large = to_int = from_int = of

    @staticmethod
    def add(a, b) -> Column:
        return Int.of(a) + Int.of(b)

    @staticmethod
    def sub(a, b) -> Column:
        return Int.of(a) - Int.of(b)

    @staticmethod
    def mul(a, b) -> Column:
        return Int.of(a) * Int.of(b)

    @staticmethod
    def quot(a, b) -> Column:
        """Division towards zero."""
        a, b = col(a).cast("long"), col(b).cast("long")
        return raises("Div", b != 0, F.try_divide(a - F.when(b != 0, a % F.when(b != 0, b)), b).cast("long")).cast("int")

    @staticmethod
    def rem(a, b) -> Column:
        a, b = col(a), col(b)
        return raises("Div", b != 0, a % F.when(b != 0, b)).cast("int")

    @staticmethod
    def mod(a, b) -> Column:
        """The remainder with the divisor's sign."""
        r, b = Int.rem(a, b), col(b)
        return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r).cast("int")

    @staticmethod
    def div(a, b) -> Column:
        """Division towards minus infinity."""
        return Int.quot(col(a).cast("long") - Int.mod(a, b), b)

    @staticmethod
    def neg(a) -> Column:
        return -Int.of(a)

    @staticmethod
    def abs(a) -> Column:
        return F.abs(Int.of(a))

    @staticmethod
    def min(a, b) -> Column:
        return F.least(col(a), col(b))

    @staticmethod
    def max(a, b) -> Column:
        return F.greatest(col(a), col(b))

    @staticmethod
    def sign(a) -> Column:
        return F.signum(col(a)).cast("int")

    @staticmethod
    def same_sign(a, b) -> Column:
        return Int.sign(a) == Int.sign(b)

    @staticmethod
    def fmt(radix: str, a) -> Column:
        a = col(a).cast("long")
        return F.concat(F.when(a < 0, "~").otherwise(""), F.conv(F.abs(a).cast("string"), 10, RADIX[radix]))

    @staticmethod
    def to_string(a) -> Column:
        return tilde(col(a).cast("string"))

    @staticmethod
    def from_string(s) -> Column:
        """The number that a string begins with after white space, or missing; Overflow if it is no int."""
        digits = F.regexp_extract(s, SPACE + r"([~+-]?[0-9]+)", 1)
        return F.when(digits != "", Int.read(F.replace(digits, F.lit("~"), F.lit("-"))))

    @staticmethod
    def read(text: Column) -> Column:
        """The int that a text is, which is computed once; Overflow if it is none."""
        return F.coalesce(text.try_cast("int"), F.raise_error(F.lit("Overflow")).cast("int"))

    @staticmethod
    def scan(radix: str, s) -> Column:
        """(value, rest) of what a string begins with, or missing."""
        digits = {"BIN": "[01]", "OCT": "[0-7]", "DEC": "[0-9]", "HEX": "[0-9A-Fa-f]"}[radix]
        pattern = SPACE + rf"([~+-]?{'(?:0[xX])?' if radix == 'HEX' else ''}{digits}+)"

        def read(text: Column) -> Column:
            magnitude = F.conv(F.regexp_replace(text, "^[~+-]?(?:0[xX])?" if radix == "HEX" else "^[~+-]", ""), RADIX[radix], 10)
            value = Int.read(F.concat(F.when(F.left(text, F.lit(1)).isin("~", "-"), "-").otherwise(""), magnitude))
            return F.when(text != "", F.struct(value.alias("_1"), F.regexp_replace(s, pattern, "").alias("_2")))

        # a bound value also keeps the columns' code in methods small enough for the JVM to compile
        return bound(F.regexp_extract(s, pattern, 1), read)


class Real:
    radix, precision = 2, 24
    max_finite, min_pos, min_normal_pos = 3.4028234663852886e38, 2.0**-149, 2.0**-126
    pos_inf, neg_inf = math.inf, -math.inf

    @staticmethod
    def wide(x) -> Column:
        return col(x).cast("double")

    @staticmethod
    def of(x) -> Column:
        return col(x).cast("float")

    from_int = of

    @staticmethod
    def add(a, b) -> Column:
        return Real.of(Real.wide(a) + Real.wide(b))

    @staticmethod
    def sub(a, b) -> Column:
        return Real.of(Real.wide(a) - Real.wide(b))

    @staticmethod
    def mul(a, b) -> Column:
        return Real.of(Real.wide(a) * Real.wide(b))

    @staticmethod
    def div(a, b) -> Column:
        """Division by zero gives an infinity or nan."""
        a, b = Real.wide(a), Real.wide(b)
        zero = F.when(F.isnan(a) | (a == 0), float("nan")).when((a > 0) == ~b.cast("string").startswith("-"), math.inf).otherwise(-math.inf)
        return Real.of(F.when(b == 0, zero).otherwise(F.try_divide(a, b)))

    @staticmethod
    def neg(a) -> Column:
        return Real.of(-Real.wide(a))

    @staticmethod
    def abs(a) -> Column:
        return F.abs(Real.of(a))

    @staticmethod
    def trunc_wide(a) -> Column:
        a = Real.wide(a)
        return F.when(a.isin(math.inf, -math.inf) | F.isnan(a), a).otherwise(F.when(a < 0, F.ceil(F.when(F.abs(a) < 9e18, a)).cast("double")).otherwise(F.floor(F.when(F.abs(a) < 9e18, a)).cast("double")))

    @staticmethod
    def signed(value: Column, a) -> Column:
        """A zero that a negative number is rounded to keeps its sign."""
        a = Real.wide(a)
        return F.when(a == 0, a).when((value == 0) & (a < 0), F.lit(-0.0)).otherwise(value)

    @staticmethod
    def whole(a) -> Column:
        """Large values have no fraction."""
        return Real.signed(F.coalesce(Real.trunc_wide(a), Real.wide(a)), a)

    @staticmethod
    def rem(a, b) -> Column:
        a, b = Real.wide(a), Real.wide(b)
        return Real.of(F.when(b == 0, float("nan")).otherwise(a % F.when(b != 0, b)))

    @staticmethod
    def min(a, b) -> Column:
        """nan loses."""
        a, b = Real.of(a), Real.of(b)
        return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))

    @staticmethod
    def max(a, b) -> Column:
        a, b = Real.of(a), Real.of(b)
        return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))

    @staticmethod
    def sign(a) -> Column:
        a = Real.wide(a)
        return raises("Domain", ~F.isnan(a), F.when(a > 0, 1).when(a < 0, -1).otherwise(0))

    @staticmethod
    def sign_bit(a) -> Column:
        return col(a).cast("string").startswith("-")

    @staticmethod
    def same_sign(a, b) -> Column:
        return Real.sign_bit(a) == Real.sign_bit(b)

    @staticmethod
    def copy_sign(a, b) -> Column:
        return F.when(Real.sign_bit(b), -F.abs(Real.of(a))).otherwise(F.abs(Real.of(a)))

    @staticmethod
    def compare(a, b) -> Column:
        a, b = Real.wide(a), Real.wide(b)
        return F.when(Real.unordered(a, b), F.raise_error(F.lit("Unordered"))).when(a == b, EQUAL).when(a < b, LESS).otherwise(GREATER)

    @staticmethod
    def unordered(a, b) -> Column:
        return F.isnan(Real.wide(a)) | F.isnan(Real.wide(b))

    # nan is unlike anything, itself included

    @staticmethod
    def eq(a, b) -> Column:
        return ~Real.unordered(a, b) & (Real.wide(a) == Real.wide(b))

    @staticmethod
    def ne(a, b) -> Column:
        return ~Real.eq(a, b)

    @staticmethod
    def lt(a, b) -> Column:
        return ~Real.unordered(a, b) & (Real.wide(a) < Real.wide(b))

    @staticmethod
    def le(a, b) -> Column:
        return ~Real.unordered(a, b) & (Real.wide(a) <= Real.wide(b))

    @staticmethod
    def gt(a, b) -> Column:
        return Real.lt(b, a)

    @staticmethod
    def ge(a, b) -> Column:
        return Real.le(b, a)

    @staticmethod
    def is_nan(a) -> Column:
        return F.isnan(Real.wide(a))

    @staticmethod
    def is_finite(a) -> Column:
        return ~Real.is_nan(a) & (F.abs(Real.wide(a)) < math.inf)

    @staticmethod
    def is_normal(a) -> Column:
        return Real.is_finite(a) & (F.abs(Real.wide(a)) >= Real.min_normal_pos)

    @staticmethod
    def to_man_exp(a) -> Column:
        """{exp, man} with a = man * 2^exp and man in [0.5, 1), or a itself with exp 0 where there is none."""
        a = Real.wide(a)
        plain = ~Real.is_finite(a) | (a == 0)
        safe = F.when(~plain, a)
        exp = (F.floor(F.log2(F.abs(safe))) + 1).cast("int")
        exp = F.when(F.abs(safe) >= F.pow(F.lit(2.0), exp), exp + 1).when(F.abs(safe) < F.pow(F.lit(2.0), exp - 1), exp - 1).otherwise(exp)
        return F.struct(F.when(plain, 0).otherwise(exp).alias("exp"), Real.of(F.when(plain, a).otherwise(safe / F.pow(F.lit(2.0), exp))).alias("man"))

    @staticmethod
    def from_man_exp(r) -> Column:
        return Real.of(Real.wide(r["man"]) * F.pow(F.lit(2.0), r["exp"]))

    @staticmethod
    def split(a) -> Column:
        """{frac, whole}"""
        return F.struct(Real.real_mod(a).alias("frac"), Real.of(Real.whole(a)).alias("whole"))

    @staticmethod
    def real_mod(a) -> Column:
        a = Real.wide(a)
        return Real.of(F.when(a.isin(math.inf, -math.inf), 0.0).otherwise(a - Real.whole(a)))

    @staticmethod
    def check_float(a) -> Column:
        a = Real.of(a)
        return F.when(F.isnan(a), F.raise_error(F.lit("Div"))).when(F.abs(a) == math.inf, F.raise_error(F.lit("Overflow"))).otherwise(a)

    @staticmethod
    def rounded(a, f) -> Column:
        """f of values small enough to have a fraction, others as they are."""
        a = Real.wide(a)
        small = Real.is_finite(a) & (F.abs(a) < 2.0**53)
        return Real.signed(F.when(small, f(F.when(small, a)).cast("double")).otherwise(a), a)

    @staticmethod
    def real_floor(a) -> Column:
        return Real.of(Real.rounded(a, F.floor))

    @staticmethod
    def real_ceil(a) -> Column:
        return Real.of(Real.rounded(a, F.ceil))

    @staticmethod
    def real_trunc(a) -> Column:
        return Real.of(Real.whole(a))

    @staticmethod
    def real_round(a) -> Column:
        """To the nearest, halves to the even one."""
        return Real.of(Real.rounded(a, F.rint))

    @staticmethod
    def as_int(a) -> Column:
        a = Real.wide(a)
        return F.when(F.isnan(a), F.raise_error(F.lit("Domain"))).otherwise(raises("Overflow", a.between(Int.min_int, Int.max_int), F.when(a.between(Int.min_int, Int.max_int), a).cast("int")))

    @staticmethod
    def floor(a) -> Column:
        return Real.as_int(Real.rounded(a, F.floor))

    @staticmethod
    def ceil(a) -> Column:
        return Real.as_int(Real.rounded(a, F.ceil))

    @staticmethod
    def trunc(a) -> Column:
        return Real.as_int(Real.whole(a))

    @staticmethod
    def round(a) -> Column:
        return Real.as_int(Real.rounded(a, F.rint))

    @staticmethod
    def fmt(kind: str, a, precision: int | None = None) -> Column:
        """SCI, FIX (6 digits unless told) or GEN (12); EXACT is the shortest text."""
        if precision is not None and precision < (1 if kind == "GEN" else 0):
            return F.raise_error(F.lit("Size"))
        if kind == "EXACT":
            return Real.to_string(a)
        n = precision if precision is not None else 12 if kind == "GEN" else 6
        text = F.format_string({"SCI": f"%.{n}E", "FIX": f"%.{n}f", "GEN": f"%.{n}g"}[kind], Real.wide(a))
        if kind == "SCI":
            text = F.regexp_replace(F.regexp_replace(text, r"E\+?0*([0-9])", "E$1"), r"E-0*([0-9])", "E-$1")
        if kind == "GEN":
            text = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
        return Real.special(a, tilde(text))

    @staticmethod
    def special(a, text: Column) -> Column:
        a = Real.wide(a)
        return F.when(F.isnan(a), "nan").when(a == math.inf, "inf").when(a == -math.inf, "~inf").otherwise(text)

    @staticmethod
    def to_string(a) -> Column:
        """The shortest digits that read back as the same real; an exponent outside 10^-3 to 10^7."""
        text = F.regexp_replace(F.regexp_replace(Real.of(a).cast("string"), r"\.0(?=$|E)", ""), "E-?0+$", "")
        return Real.special(a, tilde(text))

    @staticmethod
    def from_string(s) -> Column:
        text = F.regexp_extract(s, SPACE + r"([~+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][~+-]?[0-9]+)?|[~+-]?(?:inf|nan))", 1)
        plain = F.replace(text, F.lit("~"), F.lit("-"))
        return F.when(text != "", F.replace(F.replace(plain, F.lit("inf"), F.lit("Infinity")), F.lit("nan"), F.lit("NaN")).try_cast("float"))

    @staticmethod
    def scan(s) -> Column:
        found = F.regexp_extract(s, SPACE + r"[~+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][~+-]?[0-9]+)?", 0)
        return F.when(found != "", F.struct(Real.from_string(found).alias("_1"), F.substring(s, F.char_length(found) + 1, F.char_length(s)).alias("_2")))


SIGN = -(2**63)


def two_to_64() -> Column:
    return F.lit(str(2**64)).cast("decimal(38,0)")


def two_to_63() -> Column:
    return F.lit(str(2**63)).cast("decimal(38,0)")


class Word:
    """64 unsigned bits; arithmetic wraps."""

    word_size = 64

    @staticmethod
    def of(x) -> Column:
        return col(x).cast("long")

    to_large = to_large_x = to_large_word = to_large_word_x = from_large = from_large_word = from_large_int = from_int = of

    @staticmethod
    def wide(x) -> Column:
        """The unsigned value."""
        x = Word.of(x).cast("decimal(38,0)")
        return F.when(x < 0, x + two_to_64()).otherwise(x)

    @staticmethod
    def narrow(x: Column) -> Column:
        """Modulo 2^64, as signed bits."""
        whole = two_to_64()
        low = F.pmod(x, whole)
        return F.when(low >= two_to_63(), low - whole).otherwise(low).cast("long")

    @staticmethod
    def add(a, b) -> Column:
        return Word.narrow(Word.wide(a) + Word.wide(b))

    @staticmethod
    def sub(a, b) -> Column:
        return Word.narrow(Word.wide(a) - Word.wide(b))

    @staticmethod
    def mul(a, b) -> Column:
        """By halves, so that no product leaves 38 digits."""
        low = lambda x: Word.wide(Word.of(x).bitwiseAND(0xFFFFFFFF))
        high = lambda x: Word.wide(F.shiftrightunsigned(Word.of(x), 32))
        shift = F.lit(2**32).cast("decimal(11,0)")
        cross = F.pmod(low(a).cast("decimal(19,0)") * high(b).cast("decimal(18,0)") + high(a).cast("decimal(19,0)") * low(b).cast("decimal(18,0)"), F.lit(2**32).cast("decimal(38,0)"))
        return Word.narrow((low(a).cast("decimal(19,0)") * low(b).cast("decimal(18,0)")).cast("decimal(38,0)") + (cross.cast("decimal(20,0)") * shift).cast("decimal(38,0)"))

    @staticmethod
    def div(a, b) -> Column:
        b_ = Word.wide(b)
        return raises("Div", b_ != 0, Word.narrow(((Word.wide(a) - F.try_mod(Word.wide(a), b_)) / F.when(b_ != 0, b_)).cast("decimal(38,0)")))

    @staticmethod
    def mod(a, b) -> Column:
        b_ = Word.wide(b)
        return raises("Div", b_ != 0, Word.narrow(F.try_mod(Word.wide(a), b_)))

    @staticmethod
    def neg(a) -> Column:
        return Word.sub(F.lit(0), a)

    @staticmethod
    def andb(a, b) -> Column:
        return Word.of(a).bitwiseAND(Word.of(b))

    @staticmethod
    def orb(a, b) -> Column:
        return Word.of(a).bitwiseOR(Word.of(b))

    @staticmethod
    def xorb(a, b) -> Column:
        return Word.of(a).bitwiseXOR(Word.of(b))

    @staticmethod
    def notb(a) -> Column:
        return F.bitwise_not(Word.of(a))

    @staticmethod
    def shift(name: str, a, n, beyond) -> Column:
        n = Word.of(n)
        return F.when(n.between(0, 63), F.call_function(name, Word.of(a), F.when(n.between(0, 63), n).cast("int"))).otherwise(beyond)

    @staticmethod
    def shl(a, n) -> Column:
        return Word.shift("shiftleft", a, n, F.lit(0))

    @staticmethod
    def shr(a, n) -> Column:
        return Word.shift("shiftrightunsigned", a, n, F.lit(0))

    @staticmethod
    def sar(a, n) -> Column:
        return Word.shift("shiftright", a, n, F.when(Word.of(a) < 0, -1).otherwise(0))

    @staticmethod
    def key(a) -> Column:
        """Signed numbers in the order of the unsigned ones."""
        return Word.of(a).bitwiseXOR(F.lit(SIGN))

    @staticmethod
    def compare(a, b) -> Column:
        return order(Word.key(a), Word.key(b))

    @staticmethod
    def lt(a, b) -> Column:
        return Word.key(a) < Word.key(b)

    @staticmethod
    def le(a, b) -> Column:
        return Word.key(a) <= Word.key(b)

    @staticmethod
    def gt(a, b) -> Column:
        return Word.key(a) > Word.key(b)

    @staticmethod
    def ge(a, b) -> Column:
        return Word.key(a) >= Word.key(b)

    @staticmethod
    def min(a, b) -> Column:
        return F.when(Word.lt(a, b), Word.of(a)).otherwise(Word.of(b))

    @staticmethod
    def max(a, b) -> Column:
        return F.when(Word.gt(a, b), Word.of(a)).otherwise(Word.of(b))

    @staticmethod
    def to_int(a) -> Column:
        return raises("Overflow", Word.of(a).between(0, Int.max_int), Word.of(a).try_cast("int"))

    to_large_int = to_int

    @staticmethod
    def to_int_x(a) -> Column:
        return raises("Overflow", Word.of(a).between(Int.min_int, Int.max_int), Word.of(a).try_cast("int"))

    to_large_int_x = to_int_x

    @staticmethod
    def fmt(radix: str, a) -> Column:
        return F.conv(Word.wide(a).cast("string"), 10, RADIX[radix])

    @staticmethod
    def to_string(a) -> Column:
        return Word.fmt("HEX", a)

    @staticmethod
    def scan(radix: str, s) -> Column:
        digits = {"BIN": "[01]", "OCT": "[0-7]", "DEC": "[0-9]", "HEX": "[0-9A-Fa-f]"}[radix]
        pattern = SPACE + rf"(?:0w[xX]?)?({digits}+)"

        def read(text: Column) -> Column:
            value = F.conv(text, RADIX[radix], 10).try_cast("decimal(38,0)")
            return F.when(text != "", F.struct(Word.narrow(value).alias("_1"), F.regexp_replace(s, pattern, "").alias("_2")))

        return bound(F.regexp_extract(s, pattern, 1), read)

    @staticmethod
    def from_string(s) -> Column:
        return Word.scan("HEX", s)["_1"]


class Math:
    pi, e = math.pi, math.e

    @staticmethod
    def pow(a, b) -> Column:
        a, b = Real.wide(a), Real.wide(b)
        return Real.of(F.when((F.abs(a) == 1) & ~Real.is_finite(b), float("nan")).otherwise(F.pow(a, b)))

    @staticmethod
    def atan2(a, b) -> Column:
        return Real.of(F.atan2(Real.wide(a), Real.wide(b)))

    @staticmethod
    def log(f, a) -> Column:
        a = Real.wide(a)
        return Real.of(F.when(a == 0, -math.inf).when((a < 0) | F.isnan(a), float("nan")).otherwise(f(a)))

    @staticmethod
    def ln(a) -> Column:
        return Math.log(F.ln, a)

    @staticmethod
    def log10(a) -> Column:
        return Math.log(F.log10, a)


for _name in ("sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "exp", "sinh", "cosh", "tanh"):
    setattr(Math, _name, staticmethod(lambda a, f=getattr(F, _name): Real.of(f(Real.wide(a)))))


@shared_comparisons
class Bool:
    @staticmethod
    def not_(a) -> Column:
        return ~col(a)

    @staticmethod
    def andalso(a, b) -> Column:
        """b is looked at only where a holds."""
        return F.when(col(a), col(b)).otherwise(False)

    @staticmethod
    def orelse(a, b) -> Column:
        return F.when(col(a), True).otherwise(col(b))

    @staticmethod
    def implies(a, b) -> Column:
        return F.when(col(a), col(b)).otherwise(True)

    @staticmethod
    def eq(a, b) -> Column:
        return col(a) == col(b)

    @staticmethod
    def ne(a, b) -> Column:
        return col(a) != col(b)

    @staticmethod
    def to_string(a) -> Column:
        return col(a).cast("string")

    @staticmethod
    def scan(s) -> Column:
        found = F.regexp_extract(s, SPACE + "(?i:true|false)", 0)
        return F.when(found != "", F.struct((F.lower(F.trim(found)).endswith("true")).alias("_1"), F.substring(s, F.char_length(found) + 1, F.char_length(s)).alias("_2")))

    @staticmethod
    def from_string(s) -> Column:
        return bound(Bool.scan(s), lambda x: x["_1"])
