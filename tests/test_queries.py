"""Registered graph queries against their SQL twins in DuckDB."""

import functools
import math

import duckdb
import pytest

import __spark_entry__ as entry
from weft.plans import graph_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def graphs(spark):
    """The graph of a least quantity, built once."""
    return functools.cache(lambda quantity: graph_queries.copurchase(spark, SF, quantity))


def key(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row)


#: Searched, peeled and propagated on fixtures of large quantities too, which have isolated parts and longer ways.
ON_FIXTURE = [n for n in sorted(graph_queries.ORACLES) if n.startswith(("bfs_", "cc_", "ktruss_", "pagerank_"))]
#: Peeling the whole table takes more than a hundred passes.
WHOLE = [n for n in sorted(graph_queries.ORACLES) if not n.startswith("ktruss_") or n == "ktruss_klimit"]


@pytest.mark.parametrize(("name", "quantity"), [(n, None) for n in WHOLE] + [(n, 46 if n.startswith("cc_") else 40) for n in ON_FIXTURE])
def test_query(spark, duck, graphs, name, quantity):
    sql = graph_queries.ORACLES[name]
    got = graph_queries.OPERATIONS[name](graphs(quantity)) if name in graph_queries.OPERATIONS else graph_queries.QUERIES[name](spark, SF)
    if quantity is not None:
        sql = sql.replace("from lineitem)", f"from lineitem where l_quantity >= {quantity})", 1)
        assert sql != graph_queries.ORACLES[name]
    want = duck.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = want.fetchall()
    place = [want.columns.index(c) for c in cols]
    assert sorted((key(r) for r in got.select(*cols).collect()), key=repr) == sorted((key(r[i] for i in place) for r in rows), key=repr)


def test_entry(spark):
    assert tuple(entry.entry(spark).first()) == (125968, 266922)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registered_queries_build_their_graph(spark):
    assert graph_queries.QUERIES["graph_size"](spark, SF).first() == (200, 8899)
    assert set(graph_queries.OPERATIONS) <= set(graph_queries.QUERIES)
    assert set(graph_queries.QUERIES) - set(graph_queries.ORACLES) == {"rmat_edges", "run_all"}
