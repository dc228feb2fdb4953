"""Operator 2: secret scans with corpus-wide ownership frequency, by SQL functions alone.

Patterns find candidates in every text. A candidate's value is hashed, and the hashes are
aggregated over the corpus by distinct repository and owner. A value that several owners hold is a
widely copied example; one that stays with a single owner looks live. Candidates of the base kinds
always stay; those of the added kinds stay where they look live.

Defined cases: a null text is empty; a text without an owner is its own owner, so copies of it are of
one owner; a null repository is one of its own; rows with equal ids or equal texts are
rows of their own; a very long text is one row and must fit a task; other columns are not carried, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, numbered, table, text_of
from tessera.llm.spans import free_of, listed, matches

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Base kinds in their order. The lengths asked for stand in the pattern where that finds the same spans.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: Kinds that the method adds.
ADDED = {
    "key_block": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "vendor": r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}",
    "generic": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}",
}
KINDS = [*BASE, *ADDED]


def candidates(text: Column) -> Column:
    """All candidates of a text: array of struct<start, order, kind, end, base, key>, by start and kind."""

    def kind(name: str, pattern: str) -> Column:
        found = matches(text, pattern)
        if name == "assign":
            found = F.filter(found, lambda s: F.char_length(F.regexp_extract(s["value"], pattern, 2)) >= 8)
        if name == "generic":  # mixed letters and digits only: prose and numbers aren't keys
            found = F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
        value = (lambda s: F.regexp_extract(s["value"], pattern, 2)) if name == "assign" else (lambda s: s["value"])
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(name)).alias("order"), F.lit(name).alias("kind"), s["end"].alias("end"), F.lit(name in BASE).alias("base"), F.sha2(value(s), 256).alias("key")
            ),
        )

    base = F.concat(*(kind(k, p) for k, p in BASE.items()))
    more = F.concat(*(kind(k, p) for k, p in ADDED.items()))

    def first_of(more: Column, base: Column) -> Column:
        """Of the added ones, those that overlap neither a base span nor an added one of an earlier kind."""
        return F.filter(more, lambda s: free_of(s, base) & ~F.exists(more, lambda o: (o["order"] < s["order"]) & (o["start"] < s["end"]) & (s["start"] < o["end"])))

    both = F.transform(F.array(F.struct(base.alias("base"), more.alias("more"))), lambda x: F.sort_array(F.concat(x["base"], F.when(F.size(x["more"]) > 0, first_of(x["more"], x["base"])).otherwise(x["more"]))))
    return both[0]


def scan(df: DataFrame, doc: str = "doc_id", text: str = "text", owner: str | Column = "source", repository: str | Column = "repository", max_owners: int = 1) -> DataFrame:
    """A row for each text: doc and secrets, array of struct<start, order, kind, end, base, owners, repositories, live>."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    read = numbered(
        df.select(F.col(doc).alias("_doc"), F.coalesce(column(owner).cast("string"), F.concat(F.lit("\0"), F.sha2(text_of(text), 256))).alias("_owner"), F.coalesce(column(repository).cast("string"), F.lit("")).alias("_repository"), text_of(text).alias("_text")).select(
            "_doc", "_owner", "_repository", candidates(F.col("_text")).alias("_found")
        )
    )
    one = read.select("_row", "_owner", "_repository", F.explode("_found").alias("s"))
    # a row for each value, owner and repository first: a value that is everywhere is counted before it is shuffled
    held = one.groupBy(F.col("s.key").alias("key"), "_owner", "_repository").agg(F.count(F.lit(1)).alias("n"))
    spread = held.groupBy("key", "_owner").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    spread = checkpointed(spread)  # written first: a join of two plain exchanges is one whose hot values can be split
    judged = one.select("_row", "s", F.col("s.key").alias("key")).join(spread, "key")
    live = F.col("owners") <= max_owners
    found = judged.where(F.col("s.base") | live).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("s.start", "s.order", "s.kind", "s.end", "s.base", "owners", "repositories", live.alias("live")))).alias("secrets")
    )
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,base:boolean,owners:bigint,repositories:bigint,live:boolean>>")
    return read.select("_row", "_doc").join(found, "_row", "left").select(F.col("_doc").alias(doc), F.coalesce("secrets", none).alias("secrets"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document. A source stands for an owner, its texts of one language for a repository."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, repository=F.concat_ws("/", "source", "lang"))
    base = F.filter("secrets", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live"),
    )
