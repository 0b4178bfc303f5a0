"""Hand graphs with answers worked out on paper, fixture goldens, strategies against each other, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions.lcg import LCG, pick_random_vertex
from weft.functions.stats import trial_stats
from weft.functions.threefry import Stream, blocks
from weft.operators import components, prep, triangles
from weft.operators.bfs import BFS, STRATEGIES
from weft.operators.graph import Graph
from weft.operators.ktruss import KTruss
from weft.operators.pagerank import PageRank
from weft.plans.graph_queries import copurchase

SF = "/root/testdata/sf0.001"


def graph(spark, n, pairs):
    return Graph(spark.createDataFrame([tuple(p) for p in pairs], "src long, dst long"), n)


HAND = {
    "path": (4, [(0, 1), (1, 2), (2, 3)], 0, 2, 1, 2),
    "triangle+isolated": (4, [(0, 1), (1, 2), (0, 2)], 1, 1, 2, 3),
    "K4+pendant": (5, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4)], 4, None, 1, 4),
    "two components": (5, [(0, 1), (2, 3), (3, 4)], 0, None, 2, 2),
    "star": (5, [(0, 2), (1, 2), (2, 3), (2, 4)], 0, 4, 1, 2),
}


@pytest.mark.parametrize("name", HAND)
def test_hand_graphs(spark, name):
    n, pairs, tri, two, comps, max_k = HAND[name]
    g = graph(spark, n, pairs)
    found = triangles.summary(g).first()
    assert found.num_triangles == tri and (two is None or found.num_twopaths == two)
    assert tuple(triangles.check(g).first()) == tuple(found)
    labels = components.component_labels(g.vertices, g.edges)
    slow, _ = components.connected_components(g)
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, slow.collect()))
    assert labels.select("component").distinct().count() == comps
    assert not any(components.check(labels, g.adj).first()) and not any(g.check().first())
    k = KTruss(g)
    assert k.max_k == max_k and not any(k.check().first())


def test_truss_of_k4_with_pendant(spark):
    g = graph(spark, *HAND["K4+pendant"][:2])
    k = KTruss(g)
    assert {(r.src, r.dst): r.kte for r in k.edges.collect()} == {(1, 0): 4, (2, 0): 4, (3, 0): 4, (2, 1): 4, (3, 1): 4, (3, 2): 4, (4, 3): 2}
    assert sorted(map(tuple, k.summary().collect())) == [(2, 5, 7), (3, 4, 6), (4, 4, 6)]
    limited = KTruss(g, 3)
    assert limited.max_k == 3 and limited.edges.filter("kte = 3").count() == 6


def test_sf0001_goldens(spark):
    g = copurchase(spark, SF, 40)
    assert (g.num_vertices, g.num_edges) == (200, 589)
    assert tuple(triangles.summary(g).first()) == (226, 1239)
    assert components.connected_components(g)[1] == 4
    k = KTruss(g)
    assert (k.max_k, k.num_iters, k.edges_per_truss) == (5, 10, [589, 414, 154, 50])
    assert [r.vertices for r in k.summary().orderBy("k").collect()] == [190, 165, 72, 25]
    klimit = KTruss(g, 8)
    assert klimit.max_k == 5
    r = PageRank(g)
    assert (r.num_iters, r.supersteps) == (18, 19) and r.residual() < 1e-5
    assert r.scores.agg(F.sum("score")).first()[0] == pytest.approx(0.9575)
    searches = {s: BFS(g, LCG()() % 200, s) for s in STRATEGIES}
    # Degrees' sums of the bottom-up levels: counted here from the levels.
    ends = {r.depth: r.ends for r in searches["migrating_threads"].levels.groupBy("depth").agg(F.sum("degree").alias("ends")).collect()}
    assert searches["beamer_hybrid"].trace == [("TD", 7, 55), ("TD", 33, 226), ("BU", 91, ends[3]), ("BU", 51, ends[4]), ("BU", 7, ends[5]), ("TD", 0, 0)]
    assert (ends[1], ends[2]) == (55, 226) and sum(ends.values()) == 2 * 589
    results = [sorted(map(tuple, b.result().collect())) for b in searches.values()]
    assert all(x == results[0] for x in results)
    for b in searches.values():
        assert b.traversed_edges() == 589 and not any(b.check().first())
        assert [r["count"] for r in b.levels.groupBy("depth").count().orderBy("depth").collect()] == [1, 7, 33, 91, 51, 7]


def test_isolated_source_and_paths(spark):
    g = graph(spark, 4, [(0, 1), (1, 2)])
    lone = BFS(g, 3)
    assert lone.traversed_edges() == 0 and lone.levels.count() == 1
    assert {r.path for r in BFS(g, 0).paths().collect()} == {"0", "1 <- 0", "2 <- 1 <- 0"}
    with pytest.raises(ValueError):
        BFS(g, 4)
    with pytest.raises(ValueError):
        Graph(g.edges, 2)


def test_random_graphs_are_relabel_invariant(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(70)}
    g = graph(spark, 25, pairs)
    h = Graph(prep.remap_vertex_ids(g.edges, 25, 9), 25)
    assert g.num_edges == h.num_edges == len(pairs)
    assert triangles.triangles(g).count() == triangles.triangles(h).count()
    assert KTruss(g).edges_per_truss == KTruss(h).edges_per_truss
    count = lambda x: components.component_labels(x.vertices, x.edges).select("component").distinct().count()
    assert count(g) == count(h)


def test_empty_graph(spark):
    g = graph(spark, 3, [])
    assert triangles.summary(g).first().num_triangles == 0
    assert components.component_labels(g.vertices, g.edges).count() == 3
    assert PageRank(g).scores.count() == 3
    assert components.connected_components(g)[0].count() == 3 and BFS(g, 1).traversed_edges() == 0
    for limit in (4, 1 << 40):
        k = KTruss(g, limit)
        assert (k.max_k, k.edges_per_truss, k.num_iters, k.edges.count()) == (2, [0], 0, 0)
        assert [tuple(r) for r in k.summary().collect()] == [(2, 0, 0)] and not any(k.check().first())


def test_preparation(spark):
    raw = spark.createDataFrame([(5, 2), (2, 5), (7, 7), (9, 2)], "src long, dst long")
    assert sorted(map(tuple, prep.canonical_edges(raw).collect())) == [(2, 5), (2, 9)]
    assert prep.max_vertex_id(raw) == 9 and prep.count_unique_vertex_ids(raw) == 4
    edges, mapping = prep.compress_vertex_ids(prep.canonical_edges(raw))
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2)] and mapping.count() == 3
    assert sorted(r.new_id for r in prep.compress_vertex_ids(raw, permute=True)[1].collect()) == [0, 1, 2, 3]
    assert [tuple(r) for r in prep.sort_edges(raw).collect()] == [(2, 5), (5, 2), (7, 7), (9, 2)]


def test_graph_accessors(spark):
    g = graph(spark, 5, HAND["K4+pendant"][1])
    lists = {r.id: r.neighbors for r in g.adjacency_lists().collect()}
    assert lists[3] == [0, 1, 2, 4]
    assert {r.id: r.neighbors for r in g.adjacency_lists(F.col("dst") % 2).collect()}[3] == [0, 2, 4, 1]
    assert {r.line for r in g.dump(oriented=True).collect()} >= {"3 -> 0 1 2", "1 -> 0"}
    assert g.edge_exists(spark.createDataFrame([(4, 3), (4, 0)], "src long, dst long")).count() == 1
    assert g.remove_edges(spark.createDataFrame([(4, 3)], "src long, dst long")).num_edges == 6
    assert g.insert_edges(spark.createDataFrame([(0, 4)], "src long, dst long")).num_edges == 8
    assert {r.place: r.share for r in g.edge_distribution(2).collect()} == {0: pytest.approx(7 / 14), 1: pytest.approx(7 / 14)}


@pytest.mark.parametrize("hub", [1, 6, 30])
def test_hubs_are_kept_beside_the_buckets(spark, hub):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)} | {(0, v) for v in range(1, 40)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    g, plain = Graph(edges, 40, hub=hub), Graph(edges, 40)
    assert g.hubs.filter(f"id < 0 or id > 39").count() == 0 and plain.hubs is None
    both = sorted((r.src, r.dst) for r in g.adj.collect())
    assert both == sorted([*pairs, *[(b, a) for a, b in pairs]])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(g.aggregate_messages(g.degrees, F.col("degree"), F.sum)) == rows(plain.aggregate_messages(plain.degrees, F.col("degree"), F.sum))
    assert rows(BFS(g, 5).result()) == rows(BFS(plain, 5).result())
    assert rows(components.connected_components(g)[0]) == rows(components.connected_components(plain)[0])


def test_joins_leave_the_adjacency_in_place(spark):
    g = graph(spark, 5, HAND["K4+pendant"][1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = g.along(g.degrees)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_maps_and_scores(spark):
    g = graph(spark, 4, [(0, 1), (1, 2)])
    assert {(r.id, r.twice) for r in g.map_vertices(twice=2 * F.col("degree")).collect()} == {(0, 2), (1, 4), (2, 2), (3, 0)}
    assert {(r.src, r.total) for r in g.map_edges(total=F.col("src") + F.col("dst")).collect()} == {(0, 1), (1, 3)}
    assert PageRank(g, 1).score(3) == pytest.approx(0.15 / 4)
    assert BFS(g, 0).frontier_sizes(2).count() == 3


def test_counter_generator():
    zero = blocks(np.zeros((1, 4), np.uint64), (0, 0, 0, 0))[0]
    assert [f"{int(x):016x}" for x in zero] == ["09218ebde6c85537", "55941f5266d86105", "4bd25e16282434dc", "ee29ec846bd2e40b"]  # published known answer
    whole = Stream(3).draws(1000)
    for skip in (0, 1, 8, 333):
        part = Stream(3)
        part.discard(skip)
        assert (np.concatenate([part.draws(5), part.draws(200)]) == whole[skip : skip + 205]).all()
    assert abs(whole.mean() / 2**32 - 0.5) < 0.03 and len(set(whole.tolist())) > 995


def test_lcg_and_statistics(spark):
    rng = LCG()
    assert [rng() for _ in range(5)] == [6364136223846793006, 13885033948157127959, 14678909342070756876, 14340359694176818205, 3490389784639564826]
    ahead, behind = LCG(7), LCG()
    for _ in range(7):
        behind()
    assert ahead() == behind()
    assert pick_random_vertex(graph(spark, 3, [(0, 1)]), LCG()) in (0, 1)
    got = trial_stats(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), "x").first()
    assert got.hmean == pytest.approx(3 / 1.75) and got.stddev == pytest.approx(1.527525)
    assert trial_stats(spark.createDataFrame([(1.0,)], "x double"), "x").first().stddev is None
