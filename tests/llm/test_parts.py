"""Parts of the operators by themselves."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.anchors import PIECE, contexts
from tessera.llm.components import components
from tessera.llm.dedup import counted_windows, remove_repeats
from tessera.llm.jaccard import from_planes, as_planes, linked, neighbourhoods, shingle_sets
from tessera.llm.pii import learn
from tessera.llm.quality import RULES, ordered
from tessera.llm import suffix


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120), st.booleans())
def test_suffix_array(data, large):
    data = bytes(b % 3 for b in data) if len(data) % 2 else data
    limit, suffix.SLICED = suffix.SLICED, 0 if large else suffix.SLICED
    try:
        assert suffix.suffix_array(data, 200).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    finally:
        suffix.SLICED = limit


def test_repeated_windows():
    first, last = suffix.repeated_windows([b"abcdefgh", b"xxcdefyy", b"q"], 4)
    assert (first.tolist(), last.tolist()) == ([2, 2, -1], [2, 2, -1])


def test_equal_windows_share_an_anchor():
    r = random.Random(3)
    text = lambda n: bytes(r.choice(b"abcdef ") for _ in range(n))
    shared = text(400)
    found = [np.concatenate(x) for x in zip(*contexts([text(300) + shared + text(100), text(77) + shared, b"", text(150)], 200))]
    by = {i: set(found[3][found[0] == i].tolist()) for i in (0, 1)}
    assert by[0] & by[1]
    covered = np.zeros(800, bool)
    for b, n in zip(found[1][found[0] == 0], found[2][found[0] == 0]):
        covered[b : b + n] = True
    assert covered.all()  # every window belongs to an anchor


def test_contexts_of_a_text_longer_than_a_piece():
    r = np.random.default_rng(5)
    body = r.integers(97, 123, PIECE + 5000, np.uint8).tobytes()
    text = body + body[PIECE - 300 : PIECE + 300]
    parts = [np.concatenate(x) for x in zip(*contexts([text], 200))]
    windows = np.zeros(len(text), np.int64)
    for b, n in zip(parts[1], parts[2]):
        windows[b : b + n - 199] += 1
    assert (windows[: len(text) - 199] == 1).all()  # each window start belongs to exactly one context


def test_groups_beyond_the_limit_have_an_exact_way(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    shared = text(260)
    df = spark.createDataFrame([(i, text(100 + i) + shared + text(50)) for i in range(8)], "doc_id long, text string")
    import tessera.llm.dedup as dedup

    usual = {r.doc_id: r.kept for r in remove_repeats(df).collect()}
    limit = dedup.covered.__defaults__
    dedup.covered.__defaults__ = (2,)
    try:
        assert {r.doc_id: r.kept for r in remove_repeats(df).collect()} == usual
    finally:
        dedup.covered.__defaults__ = limit
    assert counted_windows is not None and all(len(v) < 100 + k + 260 + 50 for k, v in usual.items())


def jaccard_roots(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=12), min_size=1, max_size=12))
def test_t_occurrence_search(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    assert linked(arrays) == jaccard_roots(arrays)


def test_search_between_sides():
    import pandas as pd

    sets = [np.arange(20), np.arange(1, 20), np.arange(100, 120), np.arange(100, 119)]
    frame = pd.DataFrame({"_set": [1, 2, 3, 4], "_shingles": [s.astype("<u8").tobytes() for s in sets], "_side": [0, 1, 0, 0]})
    assert neighbourhoods(frame, 80).to_numpy().tolist() == [[2, 1]]
    assert sorted(map(sorted, neighbourhoods(frame.assign(_side=0), 80).to_numpy().tolist())) == [[1, 2], [3, 4]]


def test_shingles_and_planes():
    a, b, c, d, e = shingle_sets([b"A b c d e f", b"a B\tc\nd e f ", b"", b"one two", b"two one"])
    assert len(a) == 2 and (a == b).all() and len(c) == 0 and len(d) == 1 and d[0] != e[0]
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 1000, np.uint64))
    assert (from_planes(as_planes(x)) == x).all()


def test_large_neighbourhoods_by_pairs_of_blocks(spark):
    from tessera.llm.jaccard import join_components

    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(30):
        w = list(words)
        w[(i * 2) % 60] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"lonely text number {i} has {i} its own {i} words") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in join_components(df).collect()}
    got = {r.doc_id: r.component_id for r in join_components(df, block=4).collect()}
    assert got == want and want[29] == 0 and want[104] == 104


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    r = random.Random(2)
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 30)], "random": [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)]}[shape]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_labelers_reliability_is_learnt():
    """Held-out accuracy on simulated votes: one good labeler and two weaker ones."""
    r = random.Random(4)

    def sample(n):
        out = []
        for _ in range(n):
            y = r.random() < 0.5
            vote = lambda p: (1 if y else -1) if r.random() < p else (-1 if y else 1)  # noqa: B023, E731
            out.append((y, (vote(0.95), vote(0.8), vote(0.65)), (f"len{'s' if (r.random() < 0.8) == y else 'l'}",)))
        return out

    from collections import Counter

    counts = Counter((v, f) for _, v, f in sample(3000))
    bias, weights, reliability = learn([(v, f, n) for (v, f), n in sorted(counts.items())])
    assert reliability[0][1][1] > reliability[1][1][1] > reliability[2][1][1]
    score = lambda v, f: bias + sum(weights.get(x, 0) for x in [*f, *(f"vote{i}:{x}" for i, x in enumerate(v))])
    test = sample(2000)
    assert sum((score(v, f) > 0) == y for y, v, f in test) / len(test) > 0.92


def test_the_order_of_rules_never_changes_the_verdict(spark):
    from tessera.llm.quality import keep_good

    df = spark.createDataFrame([(1, "word " * 60), (2, None), (3, " ".join(f"good{i}" for i in range(80))), (4, "### " * 200)], "doc_id long, text string")
    assert {r.name for r in ordered(df)} == {r.name for r in RULES}
    for rules in (RULES, RULES[::-1]):
        assert [r.doc_id for r in keep_good(df, rules=rules).collect()] == [3]


def test_spans_added_by_the_methods(spark):
    from tessera.llm.pii import detect, redact
    from tessera.llm.secrets import scan

    key = "Abcd1234Efgh5678Ijkl9012Mnop"
    rows = [(i, f"use {key} here", f"o{i}", "r") for i in range(3)] + [(9, "mine is Zyxw9876Vuts5432Rqpo1098Nmlk ok", "o9", "r")]
    found = {r.doc_id: [s.kind for s in r.secrets] for r in scan(spark.createDataFrame(rows, "doc_id long, text string, source string, repository string")).collect()}
    assert found == {0: [], 1: [], 2: [], 9: ["generic"]}  # what three owners hold is an example
    texts = [(1, "my ssn is 123-45-6789 ok"), (2, "write to a@mail.com now"), (3, "nothing to see"), (4, "My name is Mr. John Smith")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: [s.kind for s in r.spans] for r in detect(df).collect()}
    assert spans[2] == ["email"] and spans[3] == []
    masked = {r.doc_id: r.text for r in redact(df).collect()}
    assert masked[2] == "write to [EMAIL] now" and masked[3] == "nothing to see"


def test_texts_without_an_owner_are_not_one_owner(spark):
    from tessera.llm.secrets import scan

    example, own = "Abcd1234Efgh5678Ijkl9012Mnop", "Zyxw9876Vuts5432Rqpo1098Nmlk"
    rows = [(i, f"text {i} has {example} in it", None, "r") for i in range(3)] + [(i, f"mine is {own} ok", None, "r") for i in (8, 9)]
    found = {r.doc_id: [(s.kind, s.owners) for s in r.secrets] for r in scan(spark.createDataFrame(rows, "doc_id long, text string, source string, repository string")).collect()}
    assert found == {0: [], 1: [], 2: [], 8: [("generic", 1)], 9: [("generic", 1)]}
