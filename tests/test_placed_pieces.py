"""Files written in pieces of many records, and an adjacency whose buckets keep the cores busy."""

import random

from pyspark.sql import functions as F

from weft.operators import graph
from weft.sources import edge_files


def test_pieces_of_many_records(spark, tmp_path):
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(10**6), rng.randrange(10**12)) for _ in range(90_000)})
    rows = pairs[:]
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(7)
    edge_files.write_el64(edges, path := str(tmp_path / "g.el64"), 10**12)
    back = edge_files.read_el64(spark, path, ordinal=True)[0].orderBy("place").collect()
    assert [(r.src, r.dst) for r in back] == pairs
    lines = F.concat(F.col("src").cast("string"), F.lit(" "), F.col("dst").cast("string"), F.lit("\n")).cast("binary")
    edge_files._write_placed(edges, path := str(tmp_path / "g.txt"), lines, lambda n: f"{n}\n")
    assert open(path).read() == f"{len(pairs)}\n" + "".join(f"{a} {b}\n" for a, b in pairs)


def test_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_BUCKET", 10)
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 50) for i in range(50)], "src long, dst long")
    g = graph.Graph(edges, 50)
    assert g.buckets == min(10, spark.sparkContext.defaultParallelism)
    assert sorted(map(tuple, g.adj.collect())) == sorted([*map(tuple, edges.collect()), *((b, a) for a, b in edges.collect())])
