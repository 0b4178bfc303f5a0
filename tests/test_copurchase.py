"""Pairs of parts that share an order, in partitions whose number grows with the table."""

import itertools
import random

import pytest

from weft.operators import copurchase
from weft.plans.graph_queries import copurchase_edges


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Orders of many sizes, one of them large, parts that repeat in an order, a part far off, and nulls."""
    rng = random.Random(4)
    lines = [(o, rng.randrange(60)) for o in range(300) for _ in range(rng.randrange(6))] + [(7, p) for p in range(200, 400)]
    lines += [(8, 1 << 40), (8, 3), (9, None), (None, 9)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    orders = {}
    for o, p in lines:
        if o is not None and p is not None:
            orders.setdefault(o, set()).add(p)
    return path, sorted({e for parts in orders.values() for e in itertools.combinations(sorted(parts), 2)})


@pytest.mark.parametrize("lines", [1 << 20, 25])
def test_partitions_grow_in_number(spark, table, monkeypatch, lines):
    monkeypatch.setattr(copurchase, "PARTITION_LINES", lines)
    path, want = table
    edges = copurchase_edges(spark, path)
    assert sorted(map(tuple, edges.collect())) == want
    rows = spark.read.parquet(f"{path}/lineitem.parquet").count()
    assert edges.rdd.getNumPartitions() >= rows // lines
