"""Operator 1: concatenate and cut.

Pass 1 tokenizes every text and writes its ids with their offset inside the partition. The
partitions' totals, prefix-summed, give each partition's place in the one long stream of ids.
Pass 2 cuts the stream at fixed windows; a document that crosses a window leaves one record on
either side of the boundary. All sequences but the last are full, so there is no other padding.

Defined cases: a null or empty text is the end id alone; rows with equal ids are packed one by
one; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_symbols
from tessera.llm.common import checkpointed, table, text_of

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Ids of a byte-level vocabulary file.

    Where the file's merges stand in the order of their products' ids, merging by ids is merging by
    ranks and the faster library gives the same ids; other files, and texts that hold a special
    token's string, go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self.by_ranks(spec)

    @staticmethod
    def by_ranks(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        products = [model["vocab"].get(a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        plain = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or model.get("ignore_merges") or model.get("end_of_word_suffix") or None in products or any(x >= y for x, y in zip(products, products[1:])):
            return None
        import tiktoken

        byte = {c: i for i, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        if len(ranks) != 256 + len(products):
            return None
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def blob(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return self.fast.encode_to_numpy(text).astype(self.kind).tobytes()


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Ids:
    return Ids(path)


def pack(df: DataFrame, path: str, length: int = 2048, end_id: int = 1, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all texts: doc, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    kind = df.schema[doc].dataType.simpleString()

    def tokens(frames):
        ids = loaded(path)
        end, part, seen = np.array([end_id], ids.kind).tobytes(), TaskContext.get().partitionId(), 0
        width = len(end)
        for frame in frames:
            for at in range(0, len(frame), 256):
                x = frame.iloc[at : at + 256]
                blobs = [ids.blob(t) + end for t in x["_text"]]
                sizes = np.array([len(b) // width for b in blobs], np.int64)
                yield pd.DataFrame({"_doc": x["_doc"], "_part": part, "_at": seen + np.cumsum(sizes) - sizes, "_size": sizes, "_ids": blobs})
                seen += int(sizes.sum())

    written = checkpointed(
        df.select(F.col(doc).alias("_doc"), text_of(text).alias("_text")).mapInPandas(tokens, f"_doc {kind}, _part int, _at long, _size long, _ids binary")
    )
    totals = written.groupBy("_part").agg(F.sum("_size").alias("_total"))
    base = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")).alias("_base"))
    placed = written.join(F.broadcast(base), "_part").select("_doc", (F.col("_base") + F.col("_at")).alias("_start"), "_size", "_ids")  # a row for each partition

    def cut(frames):
        for frame in frames:
            for at in range(0, len(frame), 256):
                x = frame.iloc[at : at + 256]
                begin, size = x["_start"].to_numpy(), x["_size"].to_numpy()
                last = begin + size
                n = (last - 1) // length - begin // length + 1
                row = np.repeat(np.arange(len(x)), n)
                sequence = begin[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first, after = np.maximum(begin[row], sequence * length), np.minimum(last[row], (sequence + 1) * length)
                blobs = [np.frombuffer(b, "<u2" if len(b) == 2 * k else "<u4") for b, k in zip(x["_ids"], size, strict=True)]
                start = first - begin[row]
                yield pd.DataFrame({
                    "doc": x["_doc"].to_numpy()[row] if not x["_doc"].isna().any() else x["_doc"].astype(object).to_numpy()[row],
                    "start": start, "length": after - first, "doc_tokens": size[row], "sequence_id": sequence, "offset": first - sequence * length,
                    "ids": [blobs[r][s : s + k].astype("<u4").tobytes() for r, s, k in zip(row, start, after - first, strict=True)],
                })

    pieces = placed.mapInPandas(cut, f"doc {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("doc", doc)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 ids: a row for each piece."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
