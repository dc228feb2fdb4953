"""Each registered query over edge cases, against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import catalog


def rows(spark, name, folder):
    found = next(q for n, q in catalog.QUERIES.items() if n.startswith(f"{name}_"))
    return [tuple(r) for r in found(spark, folder).collect()]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert rows(spark, name.split("_")[0], empty_tables) == [] or name.startswith("op4")


@pytest.mark.parametrize("name", ["op2", "op7", "op9"])
def test_base_columns(spark, tables, documents, name):
    wanted = Counter((d, *getattr(brute, name)(t)) for d, t in documents)
    width = len(next(iter(wanted)))
    assert Counter(r[:width] for r in rows(spark, name, tables)) == wanted


def test_op1(spark, tables, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(d, np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")) for d, x in documents]
    pieces = defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows(spark, "op1", tables):
        pieces[doc].append((total, start, length, crc))
        assert 0 <= offset and offset + length <= 2048
    wanted = Counter(d for d, _ in documents)
    for d, x in ids:
        if wanted[d] == 1:
            at = 0
            for total, start, length, crc in sorted(pieces[d]):
                assert (total, start, crc) == (len(x), at, zlib.crc32(x[at : at + length].tobytes()))
                at += length
            assert at == len(x)
    sequences = defaultdict(list)
    for r in rows(spark, "op1", tables):
        sequences[r[5]].append((r[6], r[2]))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, x in sequences.items():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at == 2048 or k == max(sequences)
    assert sum(n for x in sequences.values() for _, n in x) == sum(len(x) for _, x in ids)


def test_op3(spark, tables, documents):
    got = rows(spark, "op3", tables)
    assert len(got) == len(documents)
    wanted = brute.op3(dict(documents))
    assert {r[0]: r[1:] for r in got} == wanted


def test_op6(spark, tables, documents):
    keyed = dict(enumerate(t for _, t in documents))
    wanted = Counter((documents[i][0], *v) for i, v in brute.op6(keyed).items())
    assert Counter(rows(spark, "op6", tables)) == wanted


def test_op8(spark, tables, documents):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for d, x in documents:
        ids = t.encode(x, add_special_tokens=False).ids
        wanted[d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(rows(spark, "op8", tables)) == wanted


def test_op10(spark, tables, documents):
    got = rows(spark, "op10", tables)
    assert Counter(r[0] for r in got) == Counter(d for d, _ in documents)
    wanted = brute.op10(dict(documents))
    assert {r[0]: r[1:3] for r in got} == wanted
    prints = {r[0]: r[3] for r in got}
    texts = dict(documents)
    for a in texts:
        for b in texts:
            if texts[a] == texts[b]:
                assert prints[a] == prints[b]
    for d, n, _, _, _, edited, following in got:
        assert 0 <= edited <= 1 and 0 <= following <= 1
    long_ones = [r for r in got if r[1] > 400]
    assert sum(r[5] for r in long_ones) > sum(r[6] for r in long_ones)


def test_op10_likeness_is_generalised_jaccard(spark):
    from pyspark.sql import functions as F

    from tessera.llm.fingerprints import fingerprints, likeness

    texts = ["a b c d " * 5 + " ".join(f"w{i}" for i in range(60)), "a b c d " * 9 + " ".join(f"w{i}" for i in range(20, 90))]
    grams = [Counter(zip(w, w[1:])) for w in (t.split() for t in texts)]
    true = sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())
    df = spark.createDataFrame([(1, *texts)], "k int, a string, b string")
    found = fingerprints(df, ["k"], "a", "b", 255).select(likeness(F.col("a"), F.col("b"), 255)).first()[0]
    assert abs(found - true) < 0.1


def test_op10_error_of_the_production_fingerprints(spark):
    from pyspark.sql import functions as F

    from tessera.llm.fingerprints import fingerprints, likeness

    r = random.Random(3)
    pairs, true = [], {}
    for k in range(80):
        first = [f"w{r.randrange(150)}" for _ in range(300)]
        cut = r.randrange(30, 150)
        second = first[cut:] + [f"v{r.randrange(150)}" for _ in range(cut)]
        grams = [Counter(zip(w, w[1:])) for w in (first, second)]
        true[k] = sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())
        pairs.append((k, " ".join(first), " ".join(second)))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    found = fingerprints(df, ["k"], "a", "b").select("k", likeness(F.col("a"), F.col("b"))).collect()
    assert len(found) == len(pairs)
    assert np.sqrt(np.mean([(x - true[k]) ** 2 for k, x in found])) < 0.08


def test_op10_makes_no_rows_of_terms(spark):
    from pyspark.sql import functions as F

    from tessera.llm import fingerprints as op10

    df = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(n)), "") for k, n in enumerate([1, 30, 900, 5000])], "k int, a string, b string")
    # terms were exploded for each block of samples, 22 rows a term
    assert "Generate" not in op10.fingerprints(df, ["k"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    e = op10.elements(F.sort_array(op10.terms(F.col("a"))))
    n, made = zip(*df.select(F.size(e), F.size(op10.visits(e, op10.SAMPLES, op10.enough(F.size(e), op10.SAMPLES)))).collect(), strict=True)
    assert n == (1, 29, 899, 4999)
    assert made == (67, 29 * 26, 899, 4999)


def test_op10_rounds_left_out_change_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.llm import fingerprints as op10

    r = random.Random(5)
    texts = [(k, *(" ".join(f"w{r.randrange(m)}" for _ in range(n)) for n, m in ((k % 60, 5), (20 * k, 300)))) for k in range(60)]
    df = spark.createDataFrame(texts, "k int, a string, b string")
    found = [r[1:] for r in op10.fingerprints(df, ["k"], "a", "b").sort("k").collect()]
    for limit in (1, op10.slots_of(op10.SAMPLES)):  # too few, so that all come after; all at once
        monkeypatch.setattr(op10, "enough", lambda n, samples, limit=limit: F.lit(limit))
        assert [r[1:] for r in op10.fingerprints(df, ["k"], "a", "b").sort("k").collect()] == found
    assert {len(x) for row in found for x in row} == {0, 3 * op10.SAMPLES}


def test_op10_short_texts_are_judged_without_bias(spark):
    from pyspark.sql import functions as F

    from tessera.llm.fingerprints import fingerprints, likeness

    r = random.Random(7)
    pairs, true = [], {}
    for k in range(150):
        first = [f"w{r.randrange(4)}" for _ in range(r.randrange(8, 40))]
        second = first[r.randrange(8) :] + [f"w{r.randrange(5)}" for _ in range(r.randrange(8))]
        grams = [Counter(zip(w, w[1:])) for w in (first, second)]
        true[k] = sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())
        pairs.append((k, " ".join(first), " ".join(second)))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    errors = [x - true[k] for k, x in fingerprints(df, ["k"], "a", "b").select("k", likeness(F.col("a"), F.col("b"))).collect()]
    assert len(errors) == len(pairs)
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.065


def test_op10_likenesses_are_the_shares_of_equal_samples(spark):
    found = {r[0]: r for r in rows(spark, "op10", "/root/testdata/sf0.001")}
    ids = sorted(found, reverse=True)
    share = lambda a, b: sum(a[i : i + 6] == b[i : i + 6] for i in range(0, len(a), 6)) * 6 / len(a)
    for d, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        if "-" not in found[d][3] + found[d][4] + found[after][3]:
            assert found[d][5] == pytest.approx(share(found[d][3], found[d][4]))
            assert found[d][6] == pytest.approx(share(found[d][3], found[after][3]))
