"""Operator 4: reply trees to formatted conversations, by SQL functions alone.

Pointer doubling by self-joins: after round k every message knows the ancestor 2^k steps up, the score
and the number of messages on the way, so a tree of depth d takes log d joins of fixed-size rows. Leaves
are ranked by their path's score; the rounds' tables, read once more, list the chosen leaves' ancestors,
each once. A path's messages are then formatted as one conversation.

In the output a turn is ``### Role: text</turn>`` and a line end. Inside roles and texts a backslash is
doubled, ``##`` becomes ``#\\#`` and ``</turn>`` becomes ``<\\/turn>``, so no control string is left in
them, and dropping each backslash before a character undoes it.

Defined cases: a null text or role is empty; a parent that isn't there makes its child a root; of equal
scores the smaller leaf is chosen; rows that repeat a node of a tree are an error of the input and all
formatted, at one place; a cycle has no root and is left out; other columns are not carried, whatever their
names; a very long text or conversation is one row and must fit a task; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, gathered, table

BACKSLASH = "\\"
#: Roles and how a turn's mark names them.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
END = "</turn>\n"


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    return swap(swap(swap(text, BACKSLASH, BACKSLASH * 2), "##", "#" + BACKSLASH + "#"), "</turn>", "<" + BACKSLASH + "/turn>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def label(role: Column) -> Column:
    """A known role's name; any other role as it is, marked by a backslash where it would read as a name."""
    known, other = F.lit(None).cast("string"), swap(escaped(role), ": ", ":" + BACKSLASH + " ")
    for r, name in NAMES.items():
        known = F.coalesce(known, F.when(role == r, name))
    return F.coalesce(known, F.when(role.isin(*NAMES.values()), F.concat(F.lit(BACKSLASH), other)).otherwise(other))


def role_of(mark: Column) -> Column:
    known = F.lit(None).cast("string")
    for r, name in NAMES.items():
        known = F.coalesce(known, F.when(mark == name, r))
    return F.coalesce(known, unescaped(mark))


def paths(df: DataFrame, tree: str, node: str, parent: str, score: str, best: int) -> DataFrame:
    """tree, leaf, node, place (from the root) of the best paths of each tree."""
    base = df.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"))
    ids = base.select(F.col("t").alias("t2"), F.col("n").alias("n2")).distinct()
    start = base.dropDuplicates(["t", "n"]).join(ids, base["t"].eqNullSafe(ids["t2"]) & (base["p"] == ids["n2"]), "left")
    level = checkpointed(start.select("t", "n", F.col("n2").alias("up"), "s", F.lit(1).alias("d")))
    levels = [level]
    for _ in range(level.count().bit_length() + 1):  # what hasn't reached a root by then is on a cycle
        if level.where("up is not null").limit(1).count() == 0:
            break
        above = level.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("d").alias("d2"))
        below = level.where("up is not null")  # the others have reached their root
        stepped = below.join(above, below["t"].eqNullSafe(above["t2"]) & (below["up"] == above["n2"]))
        level = checkpointed(stepped.select("t", "n", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"), (F.col("d") + F.col("d2")).alias("d")).unionByName(level.where("up is null")))
        levels.append(level)
    inner = levels[0].where("up is not null").select(F.col("t").alias("t2"), F.col("up").alias("n2")).distinct()
    leaves = level.where("up is null").join(inner, level["t"].eqNullSafe(inner["t2"]) & (level["n"] == inner["n2"]), "left_anti")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "n"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("t", F.col("n").alias("leaf"), F.col("d").alias("length"), "rank")
    walk = chosen.select("t", "leaf", "rank", "length", F.col("leaf").alias("n"), F.col("length").alias("place"))
    for k, x in enumerate(levels[:-1]):
        step = x.where("up is not null").select(F.col("t").alias("t2"), F.col("n").alias("n2"), "up")
        up = walk.join(step, walk["t"].eqNullSafe(step["t2"]) & (walk["n"] == step["n2"])).select("t", "leaf", "rank", "length", F.col("up").alias("n"), (F.col("place") - (1 << k)).alias("place"))
        walk = checkpointed(walk.unionByName(up))  # each round reads the walk twice
    return walk.select(F.col("t").alias(tree), "leaf", "rank", F.col("n").alias(node), "place")


def format_paths(df: DataFrame, tree: str, node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score", best: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss_mask (array of struct<start, end> of code points: the assistant's texts)."""
    walk = paths(df, tree, node, parent, score, best)
    said = df.select(F.col(tree).alias("t2"), F.col(node).alias("n2"), F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
    turns = walk.join(said, walk[tree].eqNullSafe(said["t2"]) & (walk[node] == said["n2"])).select(tree, "leaf", "rank", F.struct("place", "_role", "_text").alias("turn"))
    path = turns.groupBy(tree, "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    parts = F.transform("turns", lambda x: F.struct(F.concat(F.lit("### "), label(x["_role"]), F.lit(": ")).alias("head"), escaped(x["_text"]).alias("body"), (x["_role"] == "assistant").alias("loss")))

    def mark(at: Column, x: Column) -> tuple:
        start = at + F.char_length(x["head"])
        end = start + F.char_length(x["body"])
        return end + len(END), F.struct(start.alias("start"), end.alias("end")), x["loss"]

    made = path.select(tree, "leaf", "rank", parts.alias("parts"))
    return made.select(
        tree,
        "leaf",
        "rank",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        gathered(F.col("parts"), "struct<start:int,end:int>", mark)["found"].alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct<role, text>."""
    turns = F.split(formatted, END, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    return F.transform(
        turns, lambda x: F.struct(role_of(F.substring(x, F.lit(5), F.instr(x, F.lit(": ")) - 5)).alias("role"), unescaped(F.substring(x, F.instr(x, F.lit(": ")) + 2, F.char_length(x))).alias("text"))
    )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation and one with control strings, each turn a reply to the one before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    nodes = rows.unionByName(extra).withColumn("node", order.cast("long")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.char_length("text"))
    made = format_paths(nodes, "conv_id")
    under = F.array_join(F.transform("loss_mask", lambda x: unescaped(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"]))), "")
    back = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under.alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
