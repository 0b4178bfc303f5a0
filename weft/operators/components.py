"""Connected components: by stars where only the labels matter, and by min-label propagation.

Min-label propagation is synchronous, with full pointer jumping, and counts its iterations.

One iteration gives every vertex the smallest label among itself and its neighbours, then replaces labels
by their labels' labels until nothing moves. The loop ends with the first iteration that changes nothing,
which counts. Labels end as the smallest vertex id of the component. Every superstep is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.storage import discard, stored
from weft.operators.graph import Graph


def _moved(df: DataFrame) -> int:
    return df.filter("moved").limit(1).count()


def propagate(labels: DataFrame, graph: Graph) -> tuple[DataFrame, bool]:
    """One iteration over labels (id, component) of a graph's vertices."""
    best = graph.along(labels).groupBy(F.col("dst").alias("to")).agg(F.min("component").alias("best"))
    step = labels.join(best, F.col("id") == F.col("to"), "left").select("id", F.least("component", F.coalesce("best", "component")).alias("component"), (F.coalesce("best", "component") < F.col("component")).alias("moved"))
    step = stored(step, "labels")
    if not _moved(step):
        return step, False
    while True:
        before, to = step, step.select(F.col("id").alias("of"), F.col("component").alias("next"))
        step = stored(step.join(to, F.col("component") == F.col("of")).select("id", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved")), "jumped")
        discard(before)
        if not _moved(step):
            return step, True


def connected_components(graph: Graph) -> tuple[DataFrame, int]:
    """Labels (id, component) of a graph's vertices, and the number of iterations."""
    labels, num_iters, moved = graph.vertices.select("id", F.col("id").alias("component")), 0, True
    while moved:
        before = labels
        labels, moved = propagate(labels.select("id", "component"), graph)
        num_iters += 1
        discard(before)
    return labels.select("id", "component"), num_iters


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every vertex links its higher neighbours to the lowest among itself and its neighbours."""
    adj = pairs.unionAll(pairs.select("dst", "src"))
    low = adj.groupBy(F.col("src").alias("u")).agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return adj.filter("dst > src").join(low, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every vertex links itself and its lower neighbours to the lowest of them."""
    down = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    low = down.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("low"))
    lower = down.join(low, F.col("src") == F.col("u")).filter("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return lower.unionAll(low.select("u", "low")).distinct()


def components_of_edges(edges: DataFrame) -> DataFrame:
    """Labels (id, component) of the vertices that have an edge (src, dst), by alternating large and small stars.

    It takes about as many rounds as the logarithm of the longest path, where min-label propagation can take the path's
    length, and ends when a round leaves every component as one star around its lowest vertex.
    """
    pairs = stored(edges.select("src", "dst").filter("src != dst"), "pairs")
    alone = edges.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    mark = None
    while True:
        before = pairs
        pairs = stored(_small_star(_large_star(pairs)), "stars")
        discard(before)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    return pairs.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionAll(pairs.select("dst", "dst")).unionAll(alone).groupBy("id").agg(F.min("component").alias("component"))


def component_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (id, component) of all vertices (id); one without an edge is its own component."""
    found = components_of_edges(edges).select(F.col("id").alias("v"), "component")
    return stored(vertices.join(found, F.col("id") == F.col("v"), "left").select("id", F.coalesce("component", "id").alias("component")), "components")


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def ranges(labels: DataFrame) -> DataFrame:
    """(component, line): `Component c: 0-3, 7`, maximal runs of ids of a component."""
    # Runs are found from neighbours in id (id - 1, id + 1), not by numbering a component's rows, so no task holds one.
    other = labels.select(F.col("id").alias("o"), F.col("component").alias("oc"))
    below = labels.join(other, (F.col("o") == F.col("id") - 1) & (F.col("oc") == F.col("component")), "left_anti").select("component", F.col("id").alias("lo"))
    above = labels.join(other, (F.col("o") == F.col("id") + 1) & (F.col("oc") == F.col("component")), "left_anti").select("component", F.col("id").alias("hi"))
    lists = below.groupBy("component").agg(F.array_sort(F.collect_list("lo")).alias("lo")).join(above.groupBy("component").agg(F.array_sort(F.collect_list("hi")).alias("hi")), "component")
    text = lambda x: F.when(x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string")))
    return lists.select("component", F.concat(F.lit("Component "), F.col("component").cast("string"), F.lit(": "), F.array_join(F.transform(F.arrays_zip("lo", "hi"), text), ", ")).alias("line"))


def check(labels: DataFrame, adj: DataFrame) -> DataFrame:
    """One row of violations: edges between labels, labels that are not the smallest id of their vertices."""
    a = labels.select(F.col("id").alias("src"), F.col("component").alias("ca"))
    b = labels.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    split = adj.join(a, "src").join(b, "dst").agg(F.count_if(F.col("ca") != F.col("cb")).alias("split_edges"))
    least = labels.groupBy("component").agg(F.min("id").alias("least")).agg(F.count_if(F.col("least") != F.col("component")).alias("wrong_labels"))
    return split.crossJoin(least)  # one row each
