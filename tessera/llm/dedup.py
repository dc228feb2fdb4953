"""Operator 6: removal of repeated passages by suffix arrays over all texts.

Every two equal windows share a content-defined anchor (``anchors``), so windows are grouped by their
anchors' hashes. Hashes that stand once are done. Of the others, equal contexts are collapsed before
anything is sorted; the different contexts of a hash go into one block, whose suffix array is built in
two stages (``suffix``), and neighbours with a common prefix of a window's length are repeats. A hash
with very many different contexts would not fit a task: its windows are counted by their own hashes.

The windows that choose one anchor overlap each other, so what is covered of a context is one interval.

Two contexts of one hash are taken as equal where their 64-bit hashes are: a group of a million different
contexts has two that collide with a probability of 3 in 10^8. Texts are told apart by 64-bit hashes.

Defined cases: a null text is empty; rows with equal texts repeat each other, rows with equal ids too;
texts shorter than a window keep all; a very long text is read in pieces that overlap by a window; other
columns stay as they are, whatever their names, but that ``remove_repeats`` has n_bytes, removed and kept of
its own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import contexts
from tessera.llm.common import checkpointed, released, table, text_of
from tessera.llm.suffix import repeated_windows

WINDOW = 200
#: Different contexts of one hash up to which a task sorts them together, and bytes of a sorted block.
LARGEST_GROUP = 20_000
BLOCK = 1 << 18


def keyed(df: DataFrame, text: str, *columns: Column) -> DataFrame:
    """A text's key is its hash."""
    t = text_of(text)
    return df.select(*columns, F.xxhash64(t).alias("_key"), t.cast("binary").alias("_bytes"))


def once_each(df: DataFrame, text: str) -> DataFrame:
    """_key and _bytes of each different text: its copies are reduced to one before they are dealt."""
    return keyed(df, text).groupBy("_key").agg(F.first("_bytes").alias("_bytes"))


def places(df: DataFrame, text: str, window: int) -> DataFrame:
    """A row for each anchor of each text: _key, _begin, _length, _hash, _context."""

    def run(frames):
        for frame in frames:
            keys = frame["_key"].to_numpy()
            for which, begin, length, key, context in contexts(frame["_bytes"].tolist(), window):
                yield pd.DataFrame({"_key": keys[which], "_begin": begin, "_length": length, "_hash": key, "_context": context})
            released()

    return keyed(df, text).mapInPandas(run, "_key long, _begin int, _length int, _hash long, _context long")


def sorted_groups(parts: DataFrame, window: int) -> DataFrame:
    """Of contexts (_hash, _context, _part, ...) the covered interval [_from, _to), by suffix arrays of whole groups."""

    def run(frames):
        group: list[tuple] = []
        block: list[tuple] = []
        held = 0

        def flush():
            first, last = repeated_windows([x[2] for x in block], window)
            released()
            return pd.DataFrame({"_hash": [x[0] for x in block], "_context": [x[1] for x in block], "_from": first, "_to": last + window})[lambda x: x["_from"] >= 0]

        for frame in frames:
            for row in zip(frame["_hash"], frame["_context"], frame["_part"], strict=True):
                if group and row[0] != group[-1][0]:
                    block += group
                    held += sum(len(x[2]) for x in group)
                    group = []
                    if held >= BLOCK:
                        yield flush()
                        block, held = [], 0
                group.append(row)
        block += group
        if block:
            yield flush()

    return parts.repartition("_hash").sortWithinPartitions("_hash").mapInPandas(run, "_hash long, _context long, _from int, _to int")


def counted_windows(parts: DataFrame, window: int) -> DataFrame:
    """The same for groups too large for a task: each window's digest, counted over all contexts."""
    at = parts.select("_hash", "_context", "_part", F.explode(F.sequence(F.lit(0), F.length("_part") - window)).alias("_at"))
    digest = at.select("_hash", "_context", "_at", F.md5(F.substring("_part", F.col("_at") + 1, F.lit(window))).alias("_digest"))
    twice = digest.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return digest.join(twice, "_digest").groupBy("_hash", "_context").agg(F.min("_at").cast("int").alias("_from"), (F.max("_at") + window).cast("int").alias("_to"))


def covered(df: DataFrame, text: str, window: int, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """_key of each text with repeats, and spans: its covered intervals, not merged.

    A join is one of two plain exchanges wherever a hash, a context or a text may stand in very many rows, as
    adaptive execution splits only those: what is aggregated is written first.
    """
    every = places(df, text, window)
    often = checkpointed(every.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    hot = checkpointed(every.join(often, "_hash"))
    # equal contexts are one row from here on; the first place found stands for all
    each = hot.groupBy("_hash", "_context").agg(F.count(F.lit(1)).alias("_n"), F.first("_key").alias("_key"), F.first("_begin").alias("_begin"), F.first("_length").alias("_length"))
    each = checkpointed(each)
    groups = each.groupBy("_hash").agg(F.count(F.lit(1)).alias("_different")).where("_different > 1")
    compared = each.join(groups, "_hash")
    wanted = compared.groupBy("_key").agg(F.collect_list(F.struct("_hash", "_context", "_begin", "_length", "_different")).alias("_wanted"))
    parts = once_each(df, text).join(wanted, "_key").select("_bytes", F.explode("_wanted").alias("w"))
    parts = parts.select("w._hash", "w._context", "w._different", F.substring("_bytes", F.col("w._begin") + 1, F.col("w._length")).alias("_part"))
    large = groups.where(F.col("_different") > largest_group).limit(1).count() > 0
    found = sorted_groups(parts.where(F.col("_different") <= largest_group) if large else parts, window)
    if large:
        found = found.unionByName(counted_windows(parts.where(F.col("_different") > largest_group), window))
    whole = each.where("_n > 1").select("_hash", "_context", F.lit(0).alias("_from"), F.col("_length").alias("_to"))
    found = checkpointed(found.unionByName(whole).groupBy("_hash", "_context").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")))
    spans = hot.join(found, ["_hash", "_context"]).select("_key", F.struct((F.col("_begin") + F.col("_from")).alias("start"), (F.col("_begin") + F.col("_to")).alias("end")).alias("span"))
    return checkpointed(spans.groupBy("_key").agg(F.sort_array(F.collect_set("span")).alias("spans")))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of sorted intervals."""
    out: list[list[int]] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(df: DataFrame, text: str, window: int, columns: list[str]) -> DataFrame:
    """A row for each text: _0, _1, ... (the columns, whatever they are called), _size, _removed (array of struct<start, end>, in bytes), _left (binary)."""
    names = [f"_{i}" for i in range(len(columns))]
    spans = covered(df, text, window)
    texts = keyed(df, text, *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))
    both = texts.join(spans, "_key", "left").select(*names, "_bytes", F.col("spans.start").alias("_starts"), F.col("spans.end").alias("_ends"))
    kinds = [f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(columns, names, strict=True)]

    def run(frames):
        for frame in frames:
            runs = [merged(a, b) if a is not None else [] for a, b in zip(frame["_starts"], frame["_ends"], strict=True)]
            out = frame[names].copy()
            out["_size"] = [len(b) for b in frame["_bytes"]]
            out["_removed"] = [[{"start": a, "end": b} for a, b in r] for r in runs]
            out["_left"] = [b if not r else b"".join(b[x:y] for x, y in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(b)])) for b, r in zip(frame["_bytes"], runs, strict=True)]
            yield out

    return both.mapInPandas(run, ", ".join([*kinds, "_size long, _removed array<struct<start:int,end:int>>, _left binary"]))


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """A row for each text: columns keep, n_bytes, removed (array of struct<start, end>, in bytes), kept (binary).

    A column to keep that is called like one of the last three gives way to it.
    """
    kept = [c for c in keep or ["doc_id"] if c not in ("n_bytes", "removed", "kept")]
    found = cut(df, text, window, kept)
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(kept)), F.col("_size").alias("n_bytes"), F.col("_removed").alias("removed"), F.col("_left").alias("kept"))


def without_repeats(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """df, its columns in their order, with its texts as they are left; characters of which only a part is left go too."""
    rest = [c for c in df.columns if c != text]
    found = cut(df, text, window, rest)
    # what a cut leaves of a character isn't UTF-8: the bytes that are none go
    names = [f"_{i}" for i in range(len(rest))]

    def readable(frames):
        for frame in frames:
            yield frame[names].assign(_text=[b.decode("utf-8", "ignore") for b in frame["_left"]])

    kinds = [f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(rest, names, strict=True)]
    read = found.select(*names, "_left").mapInPandas(readable, ", ".join([*kinds, "_text string"]))
    back = dict(zip(rest, names, strict=True)) | {text: "_text"}
    return read.select(*(F.col(back[c]).alias(c) for c in df.columns))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages of 200 bytes or more."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long")
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
