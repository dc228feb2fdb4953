"""Operator 7: quality rules as a short-circuit cascade, by SQL functions alone.

Each rule is a Boolean column that rejects a text. A bounded sample gives each rule's share of
rejected rows and its time; the rules then stand in the order of rejection per cost, and a CASE
evaluates them one after another until one rejects. The order decides the work, never the verdict.

Defined cases: a null or empty text has no words and fails the base; rows with equal ids are rows of
their own; a very long text is one row and must fit a task; other columns stay as they are, whatever their
names; an empty table gives no rows and keeps the rules' own order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, checkpointed, once, table, text_of

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the array w.

    Windows are 64-bit hashes; only a text whose hashes aren't all different sorts them with their places.
    """

    def places(h: Column) -> Column:
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return once(
            sorted_,
            lambda t: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(t, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(t, k - 1)["h"] == x["h"]) | F.coalesce(F.get(t, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(h: Column) -> Column:
        return F.aggregate(
            places(h),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda done, i: F.struct(i.alias("last"), (done["n"] + F.least(F.lit(3), i - done["last"])).alias("n")),
            lambda done: done["n"],
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


@dataclass(frozen=True)
class Rule:
    """reject(text, words): whether the rule rejects a text."""

    name: str
    reject: object


def share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def duplicate_lines(text: Column) -> Column:
    return once(lines(text), lambda x: (F.size(x) >= 4) & share(F.size(x) - F.size(F.array_distinct(x)), F.size(x), 30))


def odd_words(w: Column, pattern: str, percent: int) -> Column:
    return share(F.size(F.filter(w, lambda x: x.rlike(pattern))), F.size(w), percent)


RULES = [
    Rule("few_words", lambda t, w: F.size(w) < 50),
    Rule("repeated_words", lambda t, w: share(repeated_words(w), F.size(w), 50)),
    Rule("symbols", lambda t, w: share(F.char_length(t) - without(t, SYMBOLS), F.size(w), 10)),
    Rule("word_length", lambda t, w: (without(t, SPACES) < F.size(w) * 3) | (without(t, SPACES) > F.size(w) * 12)),
    Rule("duplicate_lines", lambda t, w: duplicate_lines(t)),
    Rule("no_letters", lambda t, w: odd_words(w, r"^[^\p{L}]+$", 30)),
    Rule("capitals", lambda t, w: odd_words(w, r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$", 30)),
]


def ordered(df: DataFrame, text: str = "text", rules: list[Rule] = RULES, sample_rows: int = 500, repeats: int = 8) -> list[Rule]:
    """The rules by rejection per cost, the cheap and strict first, measured on sample_rows rows or so, each read several times.

    The sample's share follows the number of rows, so it is as small whatever the table's size.
    """
    t = df.select(text_of(text).alias("_t"))
    total = df.select(F.lit(1)).count()
    sample = checkpointed(t.sample(min(1.0, sample_rows / max(total, 1)), seed=7))
    many = sample.select("_t", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_again"))
    w = many.select("_t", words(F.col("_t")).alias("_w"))

    def timed(columns: list[Column]) -> tuple[float, list]:
        began = time.perf_counter()
        got = w.agg(F.count(F.lit(1)), F.sum(F.size("_w")), *columns).first()
        return time.perf_counter() - began, got

    timed([])
    least, (n, *_) = timed([])
    if not n:
        return list(rules)
    scores = {}
    for rule in rules:
        took, got = timed([F.sum(rule.reject(F.col("_t"), F.col("_w")).cast("int"))])
        scores[rule.name] = ((got[2] or 0) + 1) / (n + 2) / max(took - least, 1e-3)
    return sorted(rules, key=lambda r: -scores[r.name])


def rejected_by(text: Column, w: Column, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null: later rules aren't evaluated."""
    chain = None
    for rule in rules:
        chain = F.when(rule.reject(text, w), rule.name) if chain is None else chain.when(rule.reject(text, w), rule.name)
    return chain


def judge(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """df with rejected_by, in place of a column of that name: the first rule of the cascade that rejects the row, or null."""
    order = ordered(df, text, rules)
    return df.withColumn("rejected_by", once(words(text_of(text)), lambda w: rejected_by(text_of(text), w, order)))


def keep_good(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of df that no rule rejects."""
    order = ordered(df, text, rules)
    return df.where(once(words(text_of(text)), lambda w: rejected_by(text_of(text), w, order)).isNull())


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality measures and the verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = ordered(docs, rules=[r for r in RULES if r.name not in ("few_words", "repeated_words")])
    t = F.col("_t")
    base = docs.select("doc_id", text_of("text").alias("_t")).select(
        "doc_id",
        "_t",
        once(
            words(t),
            lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"), rejected_by(t, w, order).alias("by")),
        ).alias("m"),
        F.size(lines(t)).alias("lines"),
        F.size(F.array_distinct(lines(t))).alias("different"),
    )
    failed = (F.col("m.n") < 50) | (F.col("m.repeated") * 100 > F.col("m.n") * 50)
    return base.select(
        "doc_id",
        F.col("m.n").cast("long").alias("n_words"),
        without(t, SPACES).cast("long").alias("word_chars"),
        (F.char_length(t) - without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.col("lines") - F.col("different")).cast("long").alias("n_dup_lines"),
        F.col("m.repeated").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("m.by").isNull()).alias("kept"),
    )
