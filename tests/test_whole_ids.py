"""Graph and recursion queries, against plain Python."""

import datetime

import pytest

from tessera.plans import catalog

#: A cycle of three nodes, a chain that leaves it, a chain from 0, and two edges by themselves.
EDGES = {(100, 200), (200, 300), (300, 100), (300, 400), (400, 460), (0, 61), (61, 122), (122, 183), (183, 244), (244, 305), (3, 64), (70, 7)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    when = datetime.datetime(2020, 1, 1)
    rows = [(y, when, x, "purchase") for x, y in sorted(EDGES)] + [(5, when, 5, "purchase"), (900, when, 901, "click")]
    spark.createDataFrame([*rows, rows[0]], "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame([*EDGES, (5, 5), (100, 200)], "l_partkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 9)], "c_custkey long").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(2,), (3,)], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    return at


def walks() -> tuple[set, set]:
    """Pairs joined by a walk of an odd and of an even length."""
    odd, even = set(EDGES), set()
    while True:
        more_even = {(x, z) for x, y in odd for w, z in EDGES if w == y} - even
        more_odd = {(x, z) for x, y in even for w, z in EDGES if w == y} - odd
        if not more_even and not more_odd:
            return odd, even
        even |= more_even
        odd |= more_odd


def wanted() -> dict:
    odd, even = walks()
    path = odd | even
    return {
        "q_triangles": {(100, 200, 300)},
        "q_iterate_closure": path,
        "q_iterate_hops": {(0, 0), (61, 1), (122, 2), (183, 3), (244, 4)},
        "q_datalog_closure": path,
        "q_datalog_negation": {(x, y) for x, y in path - EDGES if (y, x) not in path},
        "q_datalog_mutual": even,
        "q_unbounded_elem": {(x, z) for x, y in EDGES for w, z in EDGES if w == y and x < z},
        "q_unbounded_orelse": {(64,), (70,), (99,)},
        "q_unbounded_closure": path,
        "q_ordered_except": {(k,) for k in (1, 4, 5, 6, 7, 8)},
    }


@pytest.mark.parametrize("name", sorted(wanted()))
def test_ids(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    got = sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    if name == "q_iterate_hops":
        got = sorted((y, hops) for hops, y in got)
    assert got == sorted(wanted()[name])
