"""Operator 8: byte-pair encoding and decoding by batched numpy merge rounds.

The distinct words of a batch of texts are encoded together. Their symbols stand in one flat
array; pairs' ranks come by binary search over the sorted pair keys, and each round merges all
occurrences of every word's lowest-rank pair. What was met before comes from a bounded cache.

Defined cases: a null or empty text has no ids; a string of a special token inside a text is
that token, as in the tokenizers library; ids outside the vocabulary decode to nothing; rows with equal ids are
rows of their own; a very long text is encoded whole; other columns stay, whatever their names, but for one that
is called like the result; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

#: Of each of two generations; a chunk that isn't met again is dropped. Longer chunks are encoded each time.
CACHE_BYTES, CACHED_CHARACTERS = 48 << 20, 64
#: What Python keeps for a chunk beside its characters and ids.
ENTRY_BYTES = 200
#: Characters outside these ranges are newer in some libraries' Unicode tables than in others'; texts with one are split by the tokenizers library's own rules.
SETTLED = regex.compile(r"[\x00-\u0557\u0900-\u0bff\u1e00-\u208e\u20a0-\u9fff\uac00-\ud7ff\ufe00-\ufffc]*+")
BATCH_WORDS = 20_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class WordBPE:
    """A vocabulary file whose words end in a suffix, read into sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        names = [""] * self.size
        for name, i in (vocab | self.specials).items():
            names[i] = name
        self.names = pa.array(names)
        self.known = np.array([n != "" for n in names])
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + self.end] for c in symbols], np.int64)
        pairs = [(vocab[a] * self.size + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.special = regex.compile("(" + ("|".join(map(regex.escape, self.specials)) or "(?!)") + ")")
        self.product = np.zeros(len(self.ranks), np.int64)
        self.product[self.ranks] = self.merged
        self.old: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.young_bytes = 0
        self.control = regex.compile(r"[\x1c-\x1f]")
        self.byte = {c: i for i, c in enumerate(symbols)}
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of pairs where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian int32, by rounds over one flat array of symbols."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), lengths)
        symbol = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.last[flat[ends]]
        none = len(self.keys)
        rank = np.full(len(symbol), none, np.int64)
        rank[:-1] = self.pair_ranks(symbol[:-1], symbol[1:])
        rank[ends] = none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            going = low < none
            if not going.all():  # words without a pair to merge leave
                done.append((word[~going], symbol[~going]))
                word, symbol, rank, low = word[going], symbol[going], rank[going], low[going]
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == low)
            run = np.flatnonzero(np.r_[True, np.diff(place) != 1])  # a pair like (x, x) overlaps itself: every other one of a run
            first = np.repeat(place[run], np.diff(np.r_[run, len(place)]))
            place = place[(place - first) % 2 == 0]
            symbol[place] = self.product[rank[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            at = np.cumsum(keep)[place] - 1
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            changed = np.r_[at, at[at > 0] - 1]  # only pairs beside a merge have a new rank
            after = np.minimum(changed + 1, len(word) - 1)
            same = (word[changed] == word[after]) & (changed < after)
            rank[changed] = np.where(same, self.pair_ranks(symbol[changed], symbol[after]), none)
        of = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        blob = ids[np.argsort(of, kind="stable")].astype("<i4").tobytes()
        cuts = np.r_[0, 4 * np.cumsum(np.bincount(of, minlength=len(raw)))].tolist()
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]

    def pieces(self, text: str) -> list[str]:
        """The words of a normalised text without white space, or of any text with unsettled characters."""
        if SETTLED.fullmatch(text):
            return self.words.findall(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in w).decode() for w, _ in found]

    def chunks(self, text: str) -> list[str]:
        """What can be encoded alone: runs between white space, which no word spans. Unsettled or unusual texts are one chunk."""
        if text.isascii():
            return text.lower().split() if not self.control.search(text) else self.words.findall(text.lower())
        if not SETTLED.fullmatch(text):
            return [text]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # character by character: no final sigma
        return text.split() if not self.control.search(text) else self.words.findall(text)

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.young.get, chunks))
        if None not in found:
            return found
        missing = {c for c, x in zip(chunks, found) if x is None}
        known = {c: self.old[c] for c in missing if c in self.old}
        if new := [c for c in missing if c not in known]:
            words = [self.pieces(c) for c in new]
            different = list({w for x in words for w in x})
            ids: dict[str, bytes] = {}
            for i in range(0, len(different), BATCH_WORDS):
                part = different[i : i + BATCH_WORDS]
                ids |= zip(part, self.merge_words(part), strict=True)
            known |= {c: b"".join(map(ids.__getitem__, x)) for c, x in zip(new, words, strict=True)}
        short = {c: x for c, x in known.items() if len(c) <= CACHED_CHARACTERS}
        self.young |= short
        self.young_bytes += sum(len(c) + len(x) for c, x in short.items()) + ENTRY_BYTES * len(short)
        return [x if x is not None else known[c] for c, x in zip(chunks, found, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        parts = [[t] if not self.special.search(t) else self.special.split(t) for t in texts]
        chunks = [[[p] if i % 2 else self.chunks(p) for i, p in enumerate(ps)] for ps in parts]
        fixed = {s: np.array([i], "<i4").tobytes() for s, i in self.specials.items()}
        flat = [c for ps in chunks for i, cs in enumerate(ps) if i % 2 == 0 for c in cs]
        ids = iter(self.ids_of(flat))
        out = [b"".join(b"".join(itertools.islice(ids, len(cs))) if i % 2 == 0 else fixed[cs[0]] for i, cs in enumerate(ps)) for ps in chunks]
        if self.young_bytes > CACHE_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens joined by a space, as the library does without a decoder."""
        flat, offsets = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ids.offsets.to_numpy()
        offsets = offsets - offsets[0]
        valid = (flat >= 0) & (flat < self.size)
        valid[valid] = self.known[flat[valid]]
        kept = np.r_[0, np.cumsum(valid)][offsets]
        names = self.names.take(pa.array(flat[valid]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), names), " ")


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


CHUNK = 64


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with its texts' ids in a column ids (array of int) in place of the text and of a column of that name; every other column stays."""
    rest = [c for c in df.columns if c not in (text, ids)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{ids}` array<int>"])

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):  # memory follows a few texts, not a whole batch
                part = batch.slice(at, CHUNK)
                blobs = bpe.encode([t or "" for t in part.column(text).to_pylist()])
                offsets = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(blobs), "<i4"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*rest, ids])

    return df.select(*(F.col(f"`{c}`") for c in rest), text_of(text).alias(text)).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the decoded text of each row's ids added, in place of a column of that name."""
    rest = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{text}` string"])

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                lists = part.column(ids)
                if lists.null_count or lists.flatten().null_count:
                    lists = pa.array([[i for i in x or [] if i is not None] for x in lists.to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), bpe.decode(lists)], names=[*rest, text])

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def op8_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: counts and digests."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
