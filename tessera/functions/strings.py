"""String, Char and StringCvt over columns. Characters are single-character strings of codes 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.base import bound, col, order, raises
from tessera.functions.collections import List
from tessera.functions.numbers import SPACE, shared_comparisons

#: The characters with escapes of their own.
ESCAPES = {"\a": "a", "\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r", '"': '"', "\\": "\\"}


def size(s) -> Column:
    """In bytes."""
    return F.octet_length(col(s))


def chars(s) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


class Chars:
    """Classes of characters, as the insides of regular expression classes."""

    classes = {
        "is_ascii": r"\x00-\x7F", "is_alpha": "A-Za-z", "is_alpha_num": "A-Za-z0-9", "is_cntrl": r"\x00-\x1F\x7F", "is_digit": "0-9", "is_graph": "!-~",
        "is_hex_digit": "0-9A-Fa-f", "is_oct_digit": "0-7", "is_lower": "a-z", "is_print": r"\x20-\x7E", "is_space": r"\x09-\x0D\x20", "is_punct": r"!-/:-@\[-`{-~", "is_upper": "A-Z",
    }


@shared_comparisons
class Char:
    min_char, max_char, max_ord = "\0", "\xff", 255

    @staticmethod
    def ord(c) -> Column:
        return F.ascii(c)

    @staticmethod
    def chr(i) -> Column:
        i = col(i)
        return raises("Chr", i.between(0, 255), F.chr(i))

    @staticmethod
    def succ(c) -> Column:
        return Char.chr(F.ascii(c) + 1)

    @staticmethod
    def pred(c) -> Column:
        return Char.chr(F.ascii(c) - 1)

    @staticmethod
    def eq(a, b) -> Column:
        return col(a) == col(b)

    @staticmethod
    def ne(a, b) -> Column:
        return col(a) != col(b)

    @staticmethod
    def contains(s, c) -> Column:
        return F.instr(col(s), col(c)) > 0

    @staticmethod
    def not_contains(s, c) -> Column:
        return F.instr(col(s), col(c)) == 0

    @staticmethod
    def to_lower(c) -> Column:
        return F.when(Char.is_upper(c), F.lower(c)).otherwise(c)

    @staticmethod
    def to_upper(c) -> Column:
        return F.when(Char.is_lower(c), F.upper(c)).otherwise(c)

    @staticmethod
    def from_int(i) -> Column:
        i = col(i)
        return F.when(i.between(0, 255), F.chr(i))

    @staticmethod
    def to_string(c) -> Column:
        """The character, or its escape."""
        code = F.ascii(c)
        out = F.when(code < 32, F.concat(F.lit("\\^"), F.chr(code + 64))).when(code >= 127, F.concat(F.lit("\\"), F.lpad(code.cast("string"), 3, "0"))).otherwise(c)
        for raw, letter in ESCAPES.items():
            out = F.when(c == raw, "\\" + letter).otherwise(out)
        return out

    @staticmethod
    def to_c_string(c) -> Column:
        code = F.ascii(c)
        out = F.when((code < 32) | (code >= 127), F.concat(F.lit("\\"), F.lpad(F.conv(code.cast("string"), 10, 8), 3, "0"))).otherwise(c)
        for raw, letter in (ESCAPES | {"'": "'", "?": "?"}).items():
            out = F.when(c == raw, "\\" + letter).otherwise(out)
        return out

    @staticmethod
    def unescaped(e) -> Column:
        """The character of one escape (or plain character), or missing."""
        code = lambda text, base: F.conv(text, base, 10).try_cast("int")
        out = F.when(F.char_length(e) == 1, F.when(e != "\\", e))
        for pattern, base in ((r"^\\([0-9]{3})$", 10), (r"^\\u([0-9A-Fa-f]{4})$", 16)):
            out = F.when(e.rlike(pattern), Char.from_int(code(F.regexp_extract(e, pattern, 1), base))).otherwise(out)
        control = r"^\\\^([@-_])$"
        out = F.when(e.rlike(control), F.chr(F.ascii(F.regexp_extract(e, control, 1)) - 64)).otherwise(out)
        for raw, letter in ESCAPES.items():
            out = F.when(e == "\\" + letter, F.lit(raw)).otherwise(out)
        return out

    ESCAPE = r"\\(?:[abtnvfr\"\\]|\^[@-_]|[0-9]{3}|u[0-9A-Fa-f]{4})"

    @staticmethod
    def from_string(s) -> Column:
        return Char.unescaped(F.regexp_extract(s, rf"^(?:{Char.ESCAPE}|[^\\])", 0))

    @staticmethod
    def scan(s) -> Column:
        found = F.regexp_extract(s, rf"^(?:{Char.ESCAPE}|[^\\])", 0)
        return F.when(found != "", F.struct(Char.unescaped(found).alias("_1"), F.substring(s, F.char_length(found) + 1, F.char_length(s)).alias("_2")))

    @staticmethod
    def from_c_string(s) -> Column:
        found = F.regexp_extract(s, r"^(?:\\(?:[abtnvfr\"'?\\]|[0-7]{1,3}|x[0-9A-Fa-f]+)|[^\\])", 0)
        octal = F.when(found.rlike(r"^\\[0-7]+$"), Char.from_int(F.conv(F.regexp_extract(found, r"([0-7]+)$", 1), 8, 10).try_cast("int")))
        hexa = F.when(found.rlike(r"^\\x"), Char.from_int(F.conv(F.regexp_extract(found, r"x([0-9A-Fa-f]+)$", 1), 16, 10).try_cast("int")))
        quoted = F.when(found.isin("\\'", "\\?"), F.substring(found, 2, 1))
        return F.coalesce(octal, hexa, quoted, Char.unescaped(found))


for _name, _class in Chars.classes.items():
    setattr(Char, _name, staticmethod(lambda c, k=_class: col(c).rlike(f"^[{k}]$")))


@shared_comparisons
class String:
    max_size = 2**24 - 1

    size = staticmethod(size)

    @staticmethod
    def sub(s, i) -> Column:
        i = col(i)
        return raises("Subscript", (i >= 0) & (i < F.char_length(s)), F.substring(s, i + 1, F.lit(1)))

    @staticmethod
    def substring(s, i, n) -> Column:
        i, n = col(i), col(n)
        return raises("Subscript", (i >= 0) & (n >= 0) & (i + n <= F.char_length(s)), F.substring(s, i + 1, n))

    @staticmethod
    def extract(s, i, n=None) -> Column:
        """From i, n characters or all the rest."""
        return String.substring(s, i, F.char_length(s) - col(i) if n is None else F.coalesce(col(n), F.char_length(s) - col(i)))

    @staticmethod
    def cat(a, b) -> Column:
        return F.concat(col(a), col(b))

    @staticmethod
    def concat(a) -> Column:
        return F.array_join(a, "")

    @staticmethod
    def concat_with(sep: str, a) -> Column:
        return F.array_join(a, sep)

    @staticmethod
    def str(c) -> Column:
        return c

    implode = concat
    explode = staticmethod(chars)

    @staticmethod
    def map(f, s) -> Column:
        return F.array_join(F.transform(chars(s), lambda c: f(c)), "")

    translate = map

    @staticmethod
    def fields(f, s) -> Column:
        """The parts between separators, empty ones too."""
        step = lambda acc, c: F.when(
            f(c), F.struct(F.concat(acc["done"], F.array(acc["part"])).alias("done"), F.lit("").alias("part"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["part"], c).alias("part")))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("part"))
        return F.aggregate(chars(s), start, step, lambda acc: F.concat(acc["done"], F.array(acc["part"])))

    @staticmethod
    def tokens(f, s) -> Column:
        return F.filter(String.fields(f, s), lambda x: x != "")

    @staticmethod
    def is_prefix(p, s) -> Column:
        return col(s).startswith(col(p))

    @staticmethod
    def is_suffix(p, s) -> Column:
        return col(s).endswith(col(p))

    @staticmethod
    def is_substring(p, s) -> Column:
        return col(s).contains(col(p))

    @staticmethod
    def collate(compare, a, b) -> Column:
        return List.collate(compare, chars(a), chars(b))

    @staticmethod
    def eq(a, b) -> Column:
        return col(a) == col(b)

    @staticmethod
    def ne(a, b) -> Column:
        return col(a) != col(b)

    @staticmethod
    def by_runs(s, alone: str, run: str, f) -> Column:
        """f of what the pattern alone finds; runs of characters that f leaves as they are go through at once."""
        parts = F.regexp_extract_all(s, F.lit(f"({run}++|{alone})"), F.lit(1))
        return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{run}"), p).otherwise(f(p))), "")

    @staticmethod
    def to_string(s) -> Column:
        return String.by_runs(s, r"[\s\S]", r"[ !#-\[\]-~]", Char.to_string)

    @staticmethod
    def to_c_string(s) -> Column:
        return String.by_runs(s, r"[\s\S]", r"[ !#-&(->@-\[\]-~]", Char.to_c_string)

    @staticmethod
    def from_string(s) -> Column:
        """Escapes undone, up to the first that is none; missing if nothing could be read of a string with something in it."""
        return String.undone(s, Char.ESCAPE, Char.unescaped)

    @staticmethod
    def undone(s, escape: str, f) -> Column:
        good = F.regexp_extract(s, rf"^(?:{escape}|[^\\]++)*+", 0)
        return bound(good, lambda g: F.when((g != "") | (s == ""), String.by_runs(g, escape, r"[^\\]", f)))

    @staticmethod
    def scan(s) -> Column:
        good = F.regexp_extract(s, rf"^(?:{Char.ESCAPE}|[^\\]++)*+", 0)
        return F.struct(String.from_string(good).alias("_1"), F.substring(s, F.char_length(good) + 1, F.char_length(s)).alias("_2"))

    @staticmethod
    def from_c_string(s) -> Column:
        return String.undone(s, r"\\(?:[abtnvfr\"'?\\]|[0-7]{1,3}|x[0-9A-Fa-f]+)", Char.from_c_string)


class StringCvt:
    """Padding, and readers that split off what a predicate takes from a string's front."""

    @staticmethod
    def pad_left(c: str, n: int, s) -> Column:
        return F.when(F.char_length(s) < n, F.lpad(s, n, c)).otherwise(s)

    @staticmethod
    def pad_right(c: str, n: int, s) -> Column:
        return F.when(F.char_length(s) < n, F.rpad(s, n, c)).otherwise(s)

    @staticmethod
    def taken(f, s) -> Column:
        """How many characters f takes."""
        return F.coalesce(F.array_position(F.transform(chars(s), lambda c: f(c)), False) - 1, F.lit(-1)).cast("int")

    @staticmethod
    def count(f, s) -> Column:
        n = StringCvt.taken(f, s)
        return F.when(n < 0, F.char_length(s)).otherwise(n)

    @staticmethod
    def takel(f, s) -> Column:
        return F.left(s, StringCvt.count(f, s))

    @staticmethod
    def dropl(f, s) -> Column:
        return F.substring(s, StringCvt.count(f, s) + 1, F.char_length(s))

    @staticmethod
    def splitl(f, s) -> Column:
        return F.struct(StringCvt.takel(f, s).alias("_1"), StringCvt.dropl(f, s).alias("_2"))

    @staticmethod
    def skip_ws(s) -> Column:
        return F.regexp_replace(s, SPACE, "")

    @staticmethod
    def scan_string(scan, s) -> Column:
        """The value that a scanner reads at the front of s, or missing."""
        return scan(s)["_1"]
