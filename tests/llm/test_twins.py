"""Registered corpus queries against their SQL twins in DuckDB, over whole tables."""

import duckdb
import pytest

from weft.llm import queries

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    place = [want.columns.index(c) for c in cols]
    assert sorted((key(r) for r in got.select(*cols).collect()), key=repr) == sorted((key(r[i] for i in place) for r in want.fetchall()), key=repr)
