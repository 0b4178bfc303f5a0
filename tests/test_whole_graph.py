"""Queries against a made table, and against brute force on a table's whole graph."""

import itertools
from collections import defaultdict

import pytest

from weft.functions.lcg import LCG
from weft.plans import graph_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Triangle 0-1-2 of small quantities and one unknown, a tail 2-3, isolated 4."""
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(1, 0, 1.0), (1, 1, 50.0), (1, 2, None), (2, 2, 39.0), (2, 3, 41.0), (3, 4, 50.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(5)], "p_partkey long").write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture(scope="module")
def whole(spark):
    """Neighbours by vertex, from all lines of the table."""
    orders = defaultdict(set)
    for o, p in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders[o].add(p)
    adj = {i: set() for i in range(spark.read.parquet(f"{SF}/part.parquet").count())}
    for parts in orders.values():
        for a, b in itertools.permutations(parts, 2):
            adj[a].add(b)
    return adj


def rows(spark, name, path):
    return sorted(tuple(r) for r in graph_queries.QUERIES[name](spark, path).collect())


def test_small(spark, small):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3)]
    assert rows(spark, "edges_canonical", small) == edges
    assert rows(spark, "el64_roundtrip", small) == edges
    assert rows(spark, "tc_summary", small) == [(1, 3)]
    assert rows(spark, "cc_labels", small) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
    assert rows(spark, "ktruss_edges", small) == [(1, 0, 3), (2, 0, 3), (2, 1, 3), (3, 2, 2)]
    assert rows(spark, "ktruss_summary", small) == [(2, 4, 4), (3, 3, 3)]


def test_bfs(spark, whole):
    source = LCG()() % len(whole)
    depth, at = {source: 0}, [source]
    for v in at:
        for w in sorted(whole[v] - depth.keys()):
            depth[w] = depth[v] + 1
            at.append(w)
    want = sorted((v, depth.get(v, -1)) for v in whole)
    for name in ("td", "rw", "beamer", "rwhybrid"):
        assert rows(spark, f"bfs_levels_{name}", SF) == want
    parents = dict(rows(spark, "bfs_parents", SF))
    assert parents[source] == source and all(p in whole[v] and depth[p] == depth[v] - 1 for v, p in parents.items() if v != source)
    assert rows(spark, "bfs_traversed", SF) == [(sum(map(len, whole.values())) // 2,)]


def test_components(spark, whole):
    assert rows(spark, "cc_labels", SF) == [(v, 0) for v in sorted(whole)]
    assert rows(spark, "cc_check", SF) == [(0, 0)]
