"""The operators' own functions over tables whose other columns have clashing names."""

import re

import brute
from pyspark.sql import functions as F

from tessera.llm.bpe import decode, encode
from tessera.llm.common import RUN
from tessera.llm.dedup import remove_repeats, without_repeats
from tessera.llm.jaccard import join_components, keep_one
from tessera.llm.packing import pack
from tessera.llm.pii import detect, redact
from tessera.llm.quality import judge, keep_good
from tessera.llm.secrets import scan
from tessera.llm.spans import matches

SHARED = "word " * 60


def clashing(spark, names, kind="string"):
    """Three documents, two with a shared passage, and columns called like what the operators use or make."""
    rows = [(1, f"first {SHARED}one"), (2, f"second {SHARED}two"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(f"{n}!").cast(kind).alias(n) for n in names))


def test_repeats_keep_columns_of_any_name(spark):
    names = ["kept", "n_bytes", "removed", "_key", "_bytes", "_hash", "_context", "_0", "_1", "_text", "spans", "a b", "x.y"]
    df = clashing(spark, names)
    made = without_repeats(df)
    assert made.columns == df.columns
    left = {r["doc_id"]: r for r in made.collect()}
    assert all(r[n] == f"{n}!" for r in left.values() for n in names)
    texts = {k: v or "" for k, v in ((r["doc_id"], r["text"]) for r in df.collect())}
    assert {k: brute.sha(r["text"]) for k, r in left.items()} == {k: v[3] for k, v in brute.op6(texts).items()}
    found = remove_repeats(df, keep=["doc_id", "kept", "_key"])
    assert found.columns == ["doc_id", "_key", "n_bytes", "removed", "kept"]


CLASHES = ["_text_key", "_key", "_set", "_doc", "_text", "_row", "_d", "_k", "_t", "n_shingles", "component_id", "rejected_by", "_found", "spans", "ids", "decoded", "a b"]


def test_one_of_each_component_keeps_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words), (5, "other " + words[::-1]), (3, words), (7, None), (8, " "), (9, words + " x"), (9, words + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(f"{n}!").alias(n) for n in CLASHES))
    made = keep_one(df)
    assert made.columns == df.columns
    got = made.collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(3, words), (5, "other " + words[::-1]), (7, ""), (8, " ")])
    assert all(r[n] == f"{n}!" for r in got for n in CLASHES)


def test_equal_ids_have_the_components_of_their_own_texts(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, "a quite different text"), (5, words), (3, words)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in join_components(df).collect()) == [(3, 3), (5, 3), (5, 5)]


def test_rules_masks_and_ids_keep_columns_of_any_name(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "word " * 20 + "mail a.b@c.org now"), (2, None), (3, "")], "doc_id long, text string").select("*", *(F.lit(f"{n}!").alias(n) for n in CLASHES))
    masked = redact(df)
    assert masked.columns == df.columns and {r.doc_id: r.text for r in masked.collect()}[1].endswith("mail [EMAIL] now")
    judged = judge(df).collect()
    assert {r.doc_id: r.rejected_by for r in judged} == {1: "few_words", 2: "few_words", 3: "few_words"} and keep_good(df).columns == df.columns
    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(df, path), path).collect()
    assert all(len(r.ids) == (r.doc_id == 1) * len(r.ids) and r["a b"] == "a b!" and r["_row"] == "_row!" for r in both)
    pieces = pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted({r.doc_id for r in pieces}) == [1, 2, 3]
    secrets = scan(df.withColumn("source", F.lit(None).cast("string")), repository=F.col("a b")).collect()
    assert [len(r.secrets) for r in secrets] == [0, 0, 0]


def test_many_matches_in_one_text(spark):
    """More matches than are gathered at once, in order and at their places."""
    text = "".join(f"<{i}> é " for i in range(3 * RUN + 5))
    df = spark.createDataFrame([(text,), ("",), ("none",)], "t string").select(matches(F.col("t"), "<[0-9]+>", 2).alias("m"))
    many, *none = (r.m for r in df.collect())
    assert [(m.start, m.end, m.value) for m in many] == [(m.start(), m.end(), m[0]) for m in re.finditer("<[0-9]+>", text)] and none == [[], []]


def test_labelers_vote_for_added_kinds(spark):
    """Planted personal data of the added kinds among look-alikes: what the trained classifier adds."""
    yes = ["My SSN is {}{}{}-45-6789.", "Please pay to IBAN: DE8937040044053201{}{}{}0.", "Name: Xiomara Quispe {}{}{}", "Dear Dr. Anna Berg, {}{}{}"]
    rows = [(4 * i + j, t.format(1 + i % 5, 1 + i % 8, 1 + i % 9)) for i in range(40) for j, t in enumerate(yes)]
    rows += [(1000 + i, f"Order 000-00-{i:04d} shipped. The Big River is wide. Part AB12CDEFGHIJKLMNOP{'QRSTUV'[i % 6]} fits.") for i in range(40)]
    found = {r.doc_id: [(s.kind, s.start) for s in r.spans if not s.base] for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = ["ssn", "iban", "person", "person"]
    assert all([k for k, _ in found[d]] == [kinds[d % 4]] for d in found if d < 1000)
    assert all(found[d] == [] for d in found if d >= 1000)
