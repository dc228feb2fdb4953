"""Operator 3: Jaccard join on word shingles by T-occurrence search.

Two sets with a Jaccard similarity of t or more share one of each set's |S| - ceil(t |S|) + 1 rarest
shingles, its prefix. Shingles that stand in one text alone come first; a text with enough of them has
no partner and is done. So only the others' shingles ever meet:

1. Chunks of texts ask, a list of short hashes for each range of hashes, which of their shingles stand
   in other texts too, and how often. A shingle is asked for once a chunk, however often it stands there.
2. Each chunk orders its texts' shingles by the answers. Texts whose prefix holds shared shingles stay.
3. Texts that share a prefix shingle, directly or over others, form a neighbourhood; components by stars.
4. Inside a neighbourhood every set is a query against the sets before it: the short inverted lists are
   merged by a heap, the long ones probed by binary search (DivideSkip), and what reaches the overlap
   is linked. Neighbourhoods too large for a task are searched pair of blocks by pair of blocks.

Shingles and sets are compared by 64-bit hashes. Defined cases: a null or empty text, or one without
words, has an empty set and no links; with fewer words than a shingle has, the whole sequence is the
one shingle; rows with equal sets are linked; rows with equal ids are rows of their own, each with the component
of its own text; a very long text is cut into shingles whole; other columns stay as they are in ``keep_one``,
whatever their names; an empty table gives no rows.

A chunk asks each range at most once and for each of its shingles at most once, so there are never more rows of
requests than shingles, however many chunks and ranges there are.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import between, mix, pieces, prefix
from tessera.llm.common import checkpointed, released, table, text_of
from tessera.llm.components import components

WORDS, PERCENT = 5, 80
#: Sets in a neighbourhood up to which one task searches it.
BLOCK = 3000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHORT = np.uint64(40)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles."""
    odd = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    lengths = [len(t) for t in texts]
    for first, last in pieces(lengths, 0):
        data = LOWER[np.frombuffer(b" ".join([b"", *texts[first:last], b""]), np.uint8)]
        space = SPACE[data]
        begin, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        if not len(begin):
            continue
        sums = prefix(data)
        word = between(sums, begin, end)
        limits = np.cumsum(np.array(lengths[first:last]) + 1)
        text = np.searchsorted(limits, begin, side="right")
        count = np.bincount(text, minlength=last - first)
        start = np.cumsum(count) - count
        n = len(word) - words + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            for j in range(words):
                h += word[j : j + n] * odd[j]
            inside = text[:n] == text[words - 1 : words - 1 + n]
            h, of = mix(h)[inside], text[:n][inside]
            by = np.lexsort((h, of))
            h, of = h[by], of[by]
            new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
            h, of = h[new], of[new]
            cuts = np.searchsorted(of, np.arange(last - first + 1))
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                out[first + i] = h[cuts[i] : cuts[i + 1]]
        for i in np.flatnonzero((count > 0) & (count < words)).tolist():
            h = int(count[i]) + int((word[start[i] : start[i] + count[i]] * odd[: count[i]]).sum(dtype=np.uint64))
            out[first + i] = mix(np.array([h % (1 << 64)], np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    h = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15
    return int(mix(np.array([h % (1 << 64)], np.uint64)).view(np.int64)[0])


def needed(a: int, b: int, percent: int) -> int:
    """The smallest overlap of sets of these sizes that links them: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def as_planes(values: np.ndarray) -> bytes:
    """Sorted 40-bit numbers byte by byte: the high bytes hardly change and compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(5, n).T
    return out.view("<u8").ravel()


def shortened(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - 40)


def asked(frame: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """Of one chunk: for each range of hashes, its different short hashes and the number of texts with each (255 at most)."""
    sets = {set_key(s): s for s in shingle_sets(frame["_bytes"].tolist()) if len(s)}
    if not sets:
        return pd.DataFrame({"_chunk": [], "_range": [], "_hashes": [], "_counts": []})
    values, counts = np.unique(shortened(np.concatenate(list(sets.values()))), return_counts=True)
    del sets
    limits = np.searchsorted(values, (np.arange(ranges + 1) << 40) // ranges)
    rows = [(i, as_planes(values[a:b]), np.minimum(counts[a:b], 255).astype(np.uint8).tobytes()) for i, (a, b) in enumerate(zip(limits, limits[1:])) if b > a]
    return pd.DataFrame({"_chunk": frame["_chunk"].iloc[0], "_range": [r[0] for r in rows], "_hashes": [r[1] for r in rows], "_counts": [r[2] for r in rows]})


def answered(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one range: to each chunk those of its hashes that stand in several texts, with the logarithm of their number."""
    lists = [from_planes(b) for b in frame["_hashes"]]
    counts = [np.frombuffer(b, np.uint8).astype(np.int64) for b in frame["_counts"]]
    values, where = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts))
    level = np.minimum(255, np.round(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    out, at = [], 0
    for chunk, values_ in zip(frame["_chunk"], lists, strict=True):
        w = where[at : at + len(values_)]
        at += len(values_)
        shared = total[w] >= 2
        if shared.any():
            out.append((chunk, as_planes(values_[shared]), level[w[shared]].tobytes()))
    return pd.DataFrame({"_chunk": [r[0] for r in out], "_shared": [r[1] for r in out], "_levels": [r[2] for r in out]})


def placed(texts: pd.DataFrame, answers: pd.DataFrame, doc: str, percent: int) -> pd.DataFrame:
    """Of one chunk: each text's set size and key; for the first text of a set that may have partners, the set and its shared prefix."""
    known = [from_planes(b) for b in answers["_shared"]]
    values = np.concatenate(known) if known else np.zeros(0, np.uint64)
    levels = np.frombuffer(b"".join(answers["_levels"]), np.uint8)
    by = np.argsort(values)
    values, levels = values[by], levels[by]
    seen: set[int] = set()
    rows = []
    for d, k, s in zip(texts["_doc"], texts["_key"], shingle_sets(texts["_bytes"].tolist()), strict=True):
        key, tokens, whole = set_key(s) if len(s) else None, None, None
        if key is not None and key not in seen and len(values):
            seen.add(key)
            short = shortened(s)
            at = np.minimum(np.searchsorted(values, short), len(values) - 1)
            shared = values[at] == short
            rest = prefix_length(len(s), percent) - int((~shared).sum())
            if rest > 0:
                few = s[shared][np.lexsort((short[shared], levels[at[shared]]))[:rest]]
                tokens, whole = few.astype("<u8").tobytes(), s.astype("<u8").tobytes()
        rows.append((d, k, len(s), key, tokens, whole))
    return pd.DataFrame(rows, columns=[doc, "_key", "n_shingles", "_set", "_prefix", "_shingles"]).astype({"_set": "Int64"})


def tidy(f, *args) -> pd.DataFrame:
    """f's result, with the memory that it took given back."""
    out = f(*args)
    released()
    return out


def order_by_size(sets: list[np.ndarray]) -> list[int]:
    return sorted(range(len(sets)), key=lambda i: len(sets[i]))


def linked(sets: list[np.ndarray], side: list[int] | None = None, percent: int = PERCENT) -> list[int]:
    """T-occurrence search of every set among the smaller ones: for each set the root of its component.

    side: with two sides only sets of different sides are compared.
    """
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = order_by_size(sets)
    sizes = np.array([len(sets[i]) for i in order])
    tokens, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(code, kind="stable")  # inverted lists: the places in order of the sets that hold a token, rising
    postings = owner[by]
    begin = np.r_[0, np.cumsum(np.bincount(code, minlength=len(tokens)))]
    at = 0
    for q in range(n):
        size = int(sizes[q])
        mine = code[at : at + size]
        at += size
        if not size:
            continue
        first = int(np.searchsorted(sizes, -(-percent * size // 100)))  # smaller sets can't reach the overlap
        if first >= q:
            continue
        lists = []
        for c in mine.tolist():
            x = postings[begin[c] : begin[c + 1]]
            lists.append(x[np.searchsorted(x, first) : np.searchsorted(x, q)])
        lists.sort(key=len)
        least = needed(size, int(sizes[first]), percent)
        long_ = least - 1  # every partner is in a list that isn't one of the long ones
        short = [x for x in lists[: size - long_] if len(x)]
        if not short:
            continue
        if sum(map(len, short)) <= 4096:
            counts = Counter(heapq.merge(*(x.tolist() for x in short)))
            candidates, hits = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        else:
            candidates, hits = np.unique(np.concatenate(short), return_counts=True)
        mine_root = find(order[q])
        keep = np.array([find(order[c]) != mine_root and (side is None or side[order[c]] != side[order[q]]) for c in candidates.tolist()], bool)
        candidates, hits = candidates[keep], hits[keep]
        required = -(-percent * (size + sizes[candidates]) // (100 + percent))
        rest = lists[size - long_ :]
        for i, x in enumerate(rest):
            if not len(candidates):
                break
            if i % 16 == 0:
                alive = hits + len(rest) - i >= required
                candidates, hits, required = candidates[alive], hits[alive], required[alive]
            if len(x):
                p = np.minimum(np.searchsorted(x, candidates), len(x) - 1)
                hits = hits + (x[p] == candidates)
        for c in candidates[hits >= required].tolist():
            a, b = find(order[c]), find(order[q])
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def neighbourhoods(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (u, v) of set keys inside one neighbourhood or pair of blocks."""
    frame = frame.drop_duplicates("_set")
    keys = frame["_set"].tolist()
    sides = frame["_side"].tolist()
    roots = linked([np.frombuffer(b, "<u8") for b in frame["_shingles"]], None if len(set(sides)) == 1 else sides, percent)
    pairs = [(k, keys[r]) for k, r in zip(keys, roots, strict=True) if keys[r] != k]
    return pd.DataFrame({"u": [p[0] for p in pairs], "v": [p[1] for p in pairs]})


def join_components(df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """A row for each text: doc, n_shingles, component_id (the smallest doc reachable by links), _key (the text's hash)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[doc].dataType.simpleString()
    t = text_of(text)
    # copies of a text are spread over chunks; chunks and ranges follow the session's partitions, which follow the data,
    # and a chunk is a part of one, as a task holds a chunk at a time
    chunks, ranges = 4 * parts, parts
    chunked = df.select(F.col(doc).alias("_doc"), F.xxhash64(t).alias("_key"), t.cast("binary").alias("_bytes"), F.pmod(F.xxhash64(F.col(doc), t), F.lit(chunks)).cast("int").alias("_chunk"))
    requests = chunked.groupBy("_chunk").applyInPandas(lambda x: tidy(asked, x, ranges), "_chunk int, _range int, _hashes binary, _counts binary")
    answers = requests.groupBy("_range").applyInPandas(lambda x: tidy(answered, x), "_chunk int, _shared binary, _levels binary")
    both = chunked.groupBy("_chunk").cogroup(answers.groupBy("_chunk"))
    sets = checkpointed(both.applyInPandas(lambda x, y: tidy(placed, x, y, doc, percent), f"`{doc}` {kind}, _key long, n_shingles long, _set long, _prefix binary, _shingles binary"))

    candidates = sets.where("_prefix is not null")

    def exploded(frames):
        for frame in frames:
            lists = [np.frombuffer(b, "<i8") for b in frame["_prefix"]]
            yield pd.DataFrame({"u": np.repeat(frame["_set"].to_numpy(), [len(x) for x in lists]), "_token": np.concatenate([*lists, np.zeros(0, np.int64)])})

    shared = candidates.select("_set", "_prefix").mapInPandas(exploded, "u long, _token long")
    tied = shared.join(shared.groupBy("_token").agg(F.min("u").alias("v"), F.max("u").alias("_last")).where("v <> _last").select("_token", "v"), "_token")
    near = components(tied.select("u", "v"))

    # a neighbourhood is one group, or if it is large, a group for each pair of its blocks
    blocks = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    b = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    dealt = near.join(blocks, "component").withColumn("_b", b).select(
        F.col("node").alias("_set"), "component", "_b", F.explode(F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))).alias("_o")
    )
    dealt = dealt.select("_set", "component", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), F.when(F.least("_b", "_o") == F.greatest("_b", "_o"), 0).otherwise(F.col("_b")).alias("_side"))
    # a set that several chunks hold is reduced to one before it is dealt
    grouped = dealt.join(candidates.select("_set", "_shingles").dropDuplicates(["_set"]), "_set").groupBy("component", "_i", "_j")
    links = grouped.applyInPandas(lambda x: tidy(neighbourhoods, x, percent), "u long, v long")
    classes = components(links)

    # back from sets to texts; the empty set is linked with nothing
    firsts = sets.where("_set is not null").groupBy("_set").agg(F.min(doc).alias("_least"))
    named = firsts.join(classes, firsts["_set"] == classes["node"], "left").select("_set", "_least", F.coalesce("component", "_set").alias("_class"))
    smallest = named.groupBy("_class").agg(F.min("_least").alias("component_id"))
    of_set = named.join(smallest, "_class").select("_set", "component_id")
    return sets.select(doc, "n_shingles", "_set", "_key").join(of_set, "_set", "left").select(doc, "n_shingles", F.coalesce("component_id", F.col(doc)).alias("component_id"), "_key")


def keep_one(df: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """df with one row of each component: that of the smallest id, and of several with that id the smallest text hash. Texts without words all stay."""
    found = checkpointed(join_components(df.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")), "_doc", "_text", percent))
    chosen = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull().alias("null"), F.col("_doc").alias("d"), F.col("_key").alias("k"))).alias("m")).select("m.d", "m.k")
    chosen = chosen.unionByName(found.where("n_shingles = 0").select(F.col("_doc").alias("d"), F.col("_key").alias("k")).distinct())
    # the row as it is, beside its id and its text's hash: no column's name can clash
    keyed = df.select(F.col(doc).alias("_d"), F.xxhash64(text_of(text)).alias("_k"), (~text_of(text).rlike(r"[^\x20\x09-\x0D]")).alias("_blank"), F.struct("*").alias("_row"))
    kept = keyed.join(chosen, keyed["_d"].eqNullSafe(chosen["d"]) & (keyed["_k"] == chosen["k"]), "left_semi")
    if found.where("n_shingles > 0").groupBy("_doc", "_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # a row that is there several times is linked with itself; rows without words aren't
        kept = kept.where("not _blank").dropDuplicates(["_d", "_k"]).unionByName(kept.where("_blank"))
    return kept.select("_row.*")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_key")
