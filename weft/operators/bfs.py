"""Breadth-first search: four strategies over the same level-synchronous state.

Levels are stored one folder each, with depth in the folder's name, so the visited set is one scan. A
parent is the smallest vertex of the level before; the source is its own parent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.storage import _shuffles_dropped_after, shared_dir, stored
from weft.operators.graph import Graph

STRATEGIES = ("migrating_threads", "remote_writes", "beamer_hybrid", "remote_writes_hybrid")


class BFS:
    """One search; `levels` (id, parent, degree, depth), `trace` [(direction, frontier, scout)]."""

    def __init__(self, graph: Graph, source: int, strategy: str = "beamer_hybrid", alpha: int = 15, beta: int = 18):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if not 0 <= source < graph.num_vertices:
            raise ValueError("source is not a vertex")
        self.graph, self.source, self.trace, self.depth, self.sizes = graph, source, [], 0, []
        self.path = f"{shared_dir(graph.spark)}/weft-bfs-{uuid.uuid4().hex}"
        first = graph.degrees.filter(F.col("id") == source).select("id", F.col("id").alias("parent"), "degree")
        scout = self._put(first)[1]
        {"migrating_threads": self._plain, "remote_writes": self._plain}.get(strategy, self._hybrid)(strategy, scout, alpha, beta)

    def _put(self, level: DataFrame) -> tuple[int, int]:
        """Store a level; its size and the sum of its degrees."""
        with _shuffles_dropped_after(self.graph.spark):
            level.select("id", "parent", "degree").write.parquet(f"{self.path}/depth={self.depth}")
        size, scout = self._level(self.depth).agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
        self.depth += 1
        self.sizes.append(size)
        return size, scout

    def _level(self, depth: int) -> DataFrame:
        return self.graph.spark.read.schema("id long, parent long, degree long").parquet(f"{self.path}/depth={depth}")

    @property
    def levels(self) -> DataFrame:
        return self.graph.spark.read.schema("id long, parent long, degree long, depth int").parquet(self.path)

    def _with_degree(self, found: DataFrame) -> DataFrame:
        return found.join(self.graph.degrees, "id")

    def _frontier_edges(self) -> DataFrame:
        """(id, src): neighbours of the frontier, and where they were met."""
        return self.graph.around(self._level(self.depth - 1), self.sizes[-1]).select(F.col("dst").alias("id"), "src")

    def top_down(self) -> DataFrame:
        """Frontier edges to unvisited vertices first, then one parent each."""
        edges = self._frontier_edges()
        return self._with_degree(edges.join(self.levels.select("id"), "id", "left_anti").groupBy("id").agg(F.min("src").alias("parent")))

    def top_down_writes(self) -> DataFrame:
        """One parent for every neighbour of the frontier first, then the unvisited ones of them."""
        edges = self._frontier_edges()
        return self._with_degree(edges.groupBy("id").agg(F.min("src").alias("parent")).join(self.levels.select("id"), "id", "left_anti"))

    def bottom_up(self) -> DataFrame:
        """Unvisited vertices look for a neighbour in the frontier."""
        asleep = self.graph.degrees.filter("degree > 0").join(self.levels.select("id"), "id", "left_anti")
        awake = self._frontier_edges().groupBy("id").agg(F.min("src").alias("parent"))
        return asleep.join(awake, "id").select("id", "parent", "degree")

    def _plain(self, strategy: str, scout: int, alpha: int, beta: int) -> None:
        step = self.top_down if strategy == "migrating_threads" else self.top_down_writes
        size = 1
        while size:
            size, scout = self._put(step())
            self.trace.append(("TD" if strategy == "migrating_threads" else "RW", size, scout))

    def _hybrid(self, strategy: str, scout: int, alpha: int, beta: int) -> None:
        other, name = (self.bottom_up, "BU") if strategy == "beamer_hybrid" else (self.top_down_writes, "RW")
        to_check, size = 2 * self.graph.num_edges, 1
        while size:
            if scout > to_check // alpha:
                while True:
                    before = size
                    size, ends = self._put(other())
                    self.trace.append((name, size, ends))
                    if not (size and (size >= before or size > self.graph.num_vertices // beta)):
                        break
                scout = 1
            else:
                to_check -= scout
                size, scout = self._put(self.top_down())
                self.trace.append(("TD", size, scout))

    def frontier(self, nodelets: int = 1) -> DataFrame:
        """(depth, nodelet, id): what the queue held at each level, by nodelet (id mod nodelets)."""
        return self.levels.select("depth", F.pmod("id", F.lit(nodelets)).alias("nodelet"), "id")

    def frontier_sizes(self, nodelets: int = 1) -> DataFrame:
        """(depth, nodelet, size) of the queue at each level; nodelets without a vertex of the level are left out."""
        return self.frontier(nodelets).groupBy("depth", "nodelet").agg(F.count(F.lit(1)).alias("size"))

    def result(self) -> DataFrame:
        """(id, depth, parent) of every vertex; -1 where not reached."""
        found = self.levels.select(F.col("id").alias("v"), "depth", "parent")
        return self.graph.vertices.join(found, F.col("id") == F.col("v"), "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("parent", F.lit(-1)).alias("parent"))

    def traversed_edges(self) -> int:
        return (self.levels.agg(F.sum("degree")).first()[0] or 0) // 2

    def trace_frame(self) -> DataFrame:
        rows = [(i + 1, *t) for i, t in enumerate(self.trace)]
        return self.graph.spark.createDataFrame(rows, "step int, direction string, frontier long, scout long")

    def paths(self) -> DataFrame:
        """(id, path): `v <- parent <- ... <- source` of each vertex reached."""
        out = self._level(0).select("id", F.col("id").cast("string").alias("path"))
        whole = out
        for depth in range(1, self.depth):
            up = out.select(F.col("id").alias("parent"), F.col("path").alias("rest"))
            out = stored(self._level(depth).join(up, "parent").select("id", F.concat(F.col("id").cast("string"), F.lit(" <- "), "rest").alias("path")), "paths")
            whole = whole.unionAll(out)
        return whole

    def check(self) -> DataFrame:
        """One row of violations, all 0 in a sound tree: wrong parents, edges that skip a level or leave the reached set, source."""
        tree = self.levels.select("id", "parent", "depth")
        up = tree.select(F.col("id").alias("parent"), F.col("depth").alias("up"))
        inner = tree.filter(F.col("id") != self.source)
        wrong = inner.join(up, "parent", "left").filter("up is null or up != depth - 1")
        false = inner.select(F.col("id").alias("src"), F.col("parent").alias("dst")).join(self.graph.adj, ["src", "dst"], "left_anti")
        a, b = (tree.select(F.col("id").alias(x), F.col("depth").alias(f"{x}_depth")) for x in ("src", "dst"))
        skip = self.graph.adj.join(a, "src").join(b, "dst", "left").filter("dst_depth is null or abs(dst_depth - src_depth) > 1")
        root = tree.filter((F.col("id") == self.source) & ((F.col("parent") != self.source) | (F.col("depth") != 0)))
        counts = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in (("wrong_depth", wrong), ("false_parent", false), ("skipped", skip), ("wrong_root", root))]
        out = counts[0]
        for c in counts[1:]:
            out = out.crossJoin(c)  # one row each
        return out
