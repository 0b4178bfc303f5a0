"""The graph: an undirected, unweighted edge list and the vertex universe 0 .. num_vertices - 1.

num_vertices is given, never derived: isolated vertices count. Every edge is kept both ways in `adj`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.storage import bucketed, stored

#: Edge ends in a bucket of the adjacency, about, and at least if that leaves cores idle; and the most buckets, which Spark allows by default.
BUCKET_ENDS, SMALL_BUCKET, MOST_BUCKETS = 1 << 22, 1 << 18, 100_000
#: A vertex with more neighbours than this, and than four buckets hold on average, is a hub: its edges are kept beside the buckets.
HUB = 1 << 20
#: Vertices that are named in a scan of their edges, at most.
NAMED = 512
# The text width that a histogram must fit, and the nodelets in a node, a chassis and a rack.
WIDTH, COLUMNS = 72, (("nodelet", 1), ("node", 8), ("chassis", 64), ("rack", 512))


class Graph:
    """Vertices, edges, adjacency and degrees as DataFrames.

    edges (src, dst) holds each undirected edge once; adj (src, dst) both directions; lo (src, dst) the direction
    with dst < src. Adjacency is stored dealt and sorted by src, so that what joins it by src leaves it in place. Hubs would
    fill a bucket, so their edges are in files that Spark splits, and `along` brings their values to them: there
    are fewer hubs than buckets.
    """

    def __init__(self, edges: DataFrame, num_vertices: int, validate: bool = True, hub: int = HUB):
        self.spark, self.num_vertices = edges.sparkSession, num_vertices
        self.edges = stored(edges.select("src", "dst"), "edges")
        bounds = self.edges.agg(F.count(F.lit(1)), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        self.num_edges = bounds[0]
        cores = self.spark.sparkContext.defaultParallelism
        self.buckets = max(1, min(MOST_BUCKETS, -(-2 * self.num_edges // BUCKET_ENDS)), min(cores, 2 * self.num_edges // SMALL_BUCKET))
        self.hub = max(hub, 8 * self.num_edges // self.buckets) if hub == HUB else hub
        if validate and bounds[0] and (bounds[1] < 0 or bounds[2] >= num_vertices):
            raise ValueError(f"vertex ids must lie in 0 .. {num_vertices - 1}; found {bounds[1]} .. {bounds[2]}")

    @property
    def ends(self) -> DataFrame:
        """Both directions of every edge, as they come."""
        return self.edges.unionAll(self.edges.select("dst", "src"))

    @cached_property
    def hubs(self) -> DataFrame | None:
        """(id) of the hubs; None if there are none."""
        found = self.degrees.filter(F.col("degree") > self.hub).select("id")
        return stored(found, "hubs") if found.limit(1).count() else None

    @cached_property
    def _light(self) -> DataFrame:
        ends = self.ends if self.hubs is None else self.ends.join(F.broadcast(self.hubs), F.col("src") == F.col("id"), "left_anti")
        return bucketed(ends, "adj", "src", self.buckets)

    @cached_property
    def _heavy(self) -> DataFrame | None:
        return None if self.hubs is None else stored(self.ends.join(F.broadcast(self.hubs), F.col("src") == F.col("id"), "left_semi"), "hub_ends")

    @property
    def adj(self) -> DataFrame:
        return self._light if self._heavy is None else self._light.unionAll(self._heavy)

    def along(self, values: DataFrame) -> DataFrame:
        """(src, dst, ...): edges in both directions with the values (id, ...) of their src; the adjacency is not moved."""
        named = values.withColumnRenamed("id", "src")
        out = self._light.join(named, "src")
        if self._heavy is not None:
            out = out.unionByName(self._heavy.join(F.broadcast(named.join(F.broadcast(self.hubs.withColumnRenamed("id", "src")), "src", "left_semi")), "src"))
        return out

    def around(self, ids: DataFrame, size: int) -> DataFrame:
        """(src, dst) of the edges of some vertices (id); a few are named in the scan, which then reads only their buckets."""
        if size <= NAMED and self._heavy is None:
            return self._light.filter(F.col("src").isin([r[0] for r in ids.select("id").collect()]))
        return self.along(ids.select("id"))

    @property
    def lo(self) -> DataFrame:
        return self.edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("dst < src")

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex."""
        counted = self.ends.groupBy(F.col("src").alias("s")).agg(F.count(F.lit(1)).alias("d"))
        return stored(self.vertices.join(counted, F.col("id") == F.col("s"), "left").select("id", F.coalesce("d", F.lit(0)).alias("degree")), "degrees")

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.num_vertices)

    def adjacency_lists(self, order: Column | None = None) -> DataFrame:
        """(id, neighbors) of the vertices that have neighbours, ascending, or by `order` over dst, then dst."""
        if order is None:
            return self.adj.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
        keyed = F.array_sort(F.collect_list(F.struct(order.alias("k"), F.col("dst"))))
        return self.adj.groupBy(F.col("src").alias("id")).agg(F.transform(keyed, lambda x: x["dst"]).alias("neighbors"))

    def dump_edges(self) -> DataFrame:
        return self.edges.select(F.format_string("%d -> %d", "src", "dst").alias("line"))

    def dump(self, oriented: bool = False) -> DataFrame:
        """`src -> n1 n2 ...` of the vertices with neighbours; oriented: lower neighbours only."""
        lists = self.lo.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors")) if oriented else self.adjacency_lists()
        return lists.select("id", F.concat_ws(" ", F.concat(F.col("id").cast("string"), F.lit(" ->")), F.array_join(F.col("neighbors").cast("array<string>"), " ")).alias("line"))

    def map_vertices(self, **columns: Column) -> DataFrame:
        """Vertices (id, degree) with computed columns."""
        return self.degrees.withColumns(columns)

    def map_edges(self, **columns: Column) -> DataFrame:
        return self.edges.withColumns(columns)

    def aggregate_messages(self, values: DataFrame, message: Column, how) -> DataFrame:
        """(id, value): `how` over `message` from each neighbour; values has id and what the message reads besides src and dst."""
        return self.along(values).groupBy(F.col("dst").alias("id")).agg(how(message).alias("value"))

    def find_neighbor(self, predicate: Column) -> DataFrame:
        """(id, neighbor): the smallest neighbour for which the predicate over (src, dst) holds."""
        return self.adj.filter(predicate).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("neighbor"))

    def edge_exists(self, pairs: DataFrame) -> DataFrame:
        """The (src, dst) pairs that are edges, in either direction."""
        return pairs.join(self.adj, ["src", "dst"], "left_semi")

    def remove_edges(self, gone: DataFrame) -> Graph:
        both = gone.select("src", "dst").unionAll(gone.select("dst", "src"))
        return Graph(self.edges.join(both, ["src", "dst"], "left_anti"), self.num_vertices)

    def insert_edges(self, new: DataFrame) -> Graph:
        return Graph(self.edges.unionAll(new.select("src", "dst")), self.num_vertices)

    def check(self, edges: DataFrame | None = None) -> DataFrame:
        """One row of counts that are all 0 in a sound graph built from `edges` (its own by default)."""
        given = self.edges if edges is None else edges.select("src", "dst")
        back = given.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        absent = given.join(self.adj, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("missing_forward"))
        reverse = back.join(self.adj, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("missing_backward"))
        twice = self.adj.groupBy("src", "dst").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicates"))
        return absent.crossJoin(reverse).crossJoin(twice)  # three rows of one count each

    def degree_distribution(self) -> DataFrame:
        return self.degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))

    def edge_distribution(self, nodelets: int, height: int = 10) -> DataFrame:
        """(kind, place, share, bar): share of edge ends by id mod nodelets, and bar height against the largest.

        Nodelets come singly, or by node, chassis or rack if their bars would not fit a line; one nodelet alone gives nothing. A
        last group that is not full is left out of the bars' number, and counts to the group before.
        """
        kind, width = next((c for c in COLUMNS if nodelets // c[1] < WIDTH), COLUMNS[-1])
        place = F.least(F.floor(F.pmod("id", F.lit(nodelets)) / width), F.lit(max(1, nodelets // width) - 1)).alias("place")
        ends = self.degrees.filter(F.lit(nodelets > 1)).groupBy(place).agg((F.sum("degree") / F.lit(2.0 * max(1, self.num_edges))).alias("share"))
        top = F.max("share").over(W.partitionBy(F.lit(1)))  # one row a group
        return ends.select(F.lit(kind).alias("kind"), "place", "share", F.coalesce(F.floor(height * F.col("share") / F.nullif(top, F.lit(0.0))), F.lit(0)).cast("long").alias("bar"))
