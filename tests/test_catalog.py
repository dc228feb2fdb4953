"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog, library, textual

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    wanted = duck.sql(catalog.ORACLES[name])
    assert columns == sorted(wanted.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(repr, duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()))


def test_every_query_has_sql():
    assert library and textual and set(catalog.QUERIES) == set(catalog.ORACLES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["q_group_compute"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "l_quantity" in schema and "l_partkey" not in schema
    joined = catalog.QUERIES["q_join_equi"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in joined and "o_orderdate" not in joined
