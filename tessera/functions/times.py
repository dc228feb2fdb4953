"""Time and Date. A time is nanoseconds in a LongType; a date is struct<ts: timestamp, offset: long ns>, in UTC where offset is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.base import col, order, raises
from tessera.functions.numbers import SPACE, shared_comparisons, tilde

SECOND = 1_000_000_000
#: Strftime directives and the date_format patterns of the same meaning.
DIRECTIVES = {"%": "'%'", "A": "EEEE", "B": "MMMM", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "Y": "yyyy", "a": "EEE", "b": "MMM", "h": "MMM", "d": "dd", "e": "d", "j": "DDD", "m": "MM", "n": "'\n'", "p": "a", "t": "'\t'", "y": "yy"}


def towards_zero(ns: Column, unit: int) -> Column:
    return F.call_function("div", ns, F.lit(unit).cast("long"))


@shared_comparisons
class Time:
    zero_time = 0

    @staticmethod
    def from_unit(n, unit: int) -> Column:
        return col(n).cast("long") * unit

    @staticmethod
    def from_seconds(n) -> Column:
        return Time.from_unit(n, SECOND)

    @staticmethod
    def from_milliseconds(n) -> Column:
        return Time.from_unit(n, 1_000_000)

    @staticmethod
    def from_microseconds(n) -> Column:
        return Time.from_unit(n, 1000)

    @staticmethod
    def from_nanoseconds(n) -> Column:
        return Time.from_unit(n, 1)

    @staticmethod
    def to_seconds(t) -> Column:
        return towards_zero(col(t), SECOND)

    @staticmethod
    def to_milliseconds(t) -> Column:
        return towards_zero(col(t), 1_000_000)

    @staticmethod
    def to_microseconds(t) -> Column:
        return towards_zero(col(t), 1000)

    @staticmethod
    def to_nanoseconds(t) -> Column:
        return col(t)

    @staticmethod
    def from_real(r) -> Column:
        r = col(r).cast("double")
        ok = ~F.isnan(r) & (F.abs(r) < 9.2e9)
        return raises("Time", ok, F.round(F.when(ok, r) * float(SECOND)).cast("long"))

    @staticmethod
    def to_real(t) -> Column:
        return (col(t).cast("double") / float(SECOND)).cast("float")

    @staticmethod
    def add(a, b) -> Column:
        return col(a) + col(b)

    @staticmethod
    def sub(a, b) -> Column:
        return col(a) - col(b)

    @staticmethod
    def now() -> Column:
        return F.unix_micros(F.current_timestamp()) * 1000

    @staticmethod
    def fmt(n: int, t) -> Column:
        """Seconds with n digits after the point."""
        return tilde((col(t).cast("decimal(20,0)") / F.lit(SECOND)).cast(f"decimal(30,{max(0, n)})").cast("string"))

    @staticmethod
    def to_string(t) -> Column:
        return Time.fmt(3, t)

    @staticmethod
    def from_string(s) -> Column:
        text = F.regexp_extract(s, SPACE + r"([~+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))", 1)
        return F.when(text != "", (F.replace(text, F.lit("~"), F.lit("-")).try_cast("decimal(28,9)") * SECOND).cast("long"))

    @staticmethod
    def scan(s) -> Column:
        found = F.regexp_extract(s, SPACE + r"[~+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)", 0)
        return F.when(found != "", F.struct(Time.from_string(found).alias("_1"), F.substring(s, F.char_length(found) + 1, F.char_length(s)).alias("_2")))


class Date:
    @staticmethod
    def of(ts, offset=None) -> Column:
        return F.struct(col(ts).cast("timestamp").alias("ts"), (F.lit(None).cast("long") if offset is None else col(offset)).alias("offset"))

    @staticmethod
    def date(year, month, day, hour=0, minute=0, second=0, offset=None) -> Column:
        """month from 1; fields out of range carry into the next ones."""
        first = F.make_date(col(year), F.lit(1), F.lit(1))
        days = F.date_add(F.add_months(first, col(month) - 1), col(day) - 1)
        seconds = col(hour) * 3600 + col(minute) * 60 + col(second)
        return Date.of(F.timestamp_seconds(F.unix_date(days).cast("long") * 86400 + seconds), offset)

    @staticmethod
    def compare(a, b) -> Column:
        return order(a["ts"], b["ts"])

    @staticmethod
    def second(d) -> Column:
        return F.second(d["ts"])

    @staticmethod
    def week_day(d) -> Column:
        """0 is Monday."""
        return F.weekday(d["ts"])

    @staticmethod
    def year_day(d) -> Column:
        return F.dayofyear(d["ts"]) - 1

    @staticmethod
    def offset(d) -> Column:
        return d["offset"]

    @staticmethod
    def is_dst(d) -> Column:
        return F.lit(None).cast("boolean")

    @staticmethod
    def local_offset() -> Column:
        return F.lit(0).cast("long")

    @staticmethod
    def from_time_univ(t) -> Column:
        return Date.of(F.timestamp_micros(towards_zero(col(t), 1000)), F.lit(0).cast("long"))

    from_time_local = from_time_univ

    @staticmethod
    def to_time(d) -> Column:
        return F.unix_micros(d["ts"]) * 1000 - F.coalesce(d["offset"], F.lit(0))

    @staticmethod
    def fmt(directives: str, d) -> Column:
        pattern, i, literal = "", 0, ""

        def flush() -> str:
            return "'" + literal.replace("'", "''") + "'" if literal else ""

        while i < len(directives):
            if directives[i] == "%" and i + 1 < len(directives) and directives[i + 1] in DIRECTIVES:
                pattern, literal = pattern + flush() + DIRECTIVES[directives[i + 1]], ""
                i += 2
            else:
                literal += directives[i]
                i += 1
        return F.date_format(d["ts"], pattern + flush())

    @staticmethod
    def to_string(d) -> Column:
        return F.date_format(d["ts"], "EEE MMM dd HH:mm:ss yyyy")

    @staticmethod
    def from_string(s) -> Column:
        text = F.regexp_extract(s, SPACE + r"(?:[A-Z][a-z]{2} )?([A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4})", 1)
        ts = F.try_to_timestamp(text, F.lit("MMM dd HH:mm:ss yyyy"))
        return F.when(ts.isNotNull(), Date.of(ts))

    @staticmethod
    def scan(s) -> Column:
        found = F.regexp_extract(s, SPACE + r"(?:[A-Z][a-z]{2} )?[A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4}", 0)
        return F.when(found != "", F.struct(Date.from_string(found).alias("_1"), F.substring(s, F.char_length(found) + 1, F.char_length(s)).alias("_2")))


for _name, _f in {"day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "month": F.month, "year": F.year}.items():
    setattr(Date, _name, staticmethod(lambda d, f=_f: f(d["ts"])))
