"""Spans of a pattern's matches, in code points, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.llm.common import gathered

SPAN = "struct<start:int,end:int,value:string,before:string>"


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """The leftmost non-overlapping matches of a pattern that can't match nothing: array of SPAN.

    The text between matches and the matches themselves, laid end to end, are the text; so their
    running lengths are the positions. ``before`` is what stands before a match, up to ``context``
    code points and back to the match before it.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def spans(hits: Column) -> Column:
        pairs = F.zip_with(
            hits,
            F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)),
            lambda hit, gap: F.struct(hit.alias("hit"), F.char_length(gap).alias("gap"), (F.substring(gap, -context, context) if context else F.lit("")).alias("before")),
        )

        def step(at: Column, x: Column) -> tuple:
            start = at + x["gap"]
            end = start + F.char_length(x["hit"])
            return end, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), x["before"].alias("before")), None

        return gathered(pairs, SPAN, step)["found"]

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(none))[0]


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def free_of(span: Column, others: Column) -> Column:
    """Whether a span overlaps none of the others."""
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))
