"""Edge-list preparation: orientation, order, duplicates, self-edges and vertex numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.storage import stored


def flip_edges(edges: DataFrame) -> DataFrame:
    """src <= dst."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def drop_self_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src != dst")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, src < dst."""
    return dedup_edges(drop_self_edges(flip_edges(edges)))


def shuffle_edges(edges: DataFrame, seed: int = 0) -> DataFrame:
    """A repeatable random order."""
    return edges.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst")


def max_vertex_id(edges: DataFrame) -> int | None:
    return edges.agg(F.max(F.greatest("src", "dst"))).first()[0]


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()


def count_unique_vertex_ids(edges: DataFrame) -> int:
    return endpoints(edges).count()


def placed(rows: DataFrame, order: list, size: str | None = None) -> DataFrame:
    """Rows with `place`, the sum of the sizes (1 each by default) of those before in the given order.

    Ranges are summed first, so that no task sees all rows.
    """
    keyed = rows.withColumn("__key", F.struct(*order)).withColumn("__size", F.col(size) if size else F.lit(1).cast("long"))
    ranged = stored(keyed.repartitionByRange("__key").withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__part").agg(F.sum("__size").alias("sum"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = sums.select("__part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("__start"))
    inside = F.sum("__size").over(W.partitionBy("__part").orderBy("__key").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__size")
    return ranged.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn("place", F.col("__start") + F.col("__inside")).drop("__key", "__size", "__part", "__start", "__inside")


def dense_ids(ids: DataFrame, order: list) -> DataFrame:
    """(id, new_id): ids numbered from 0 in the given order."""
    return placed(ids.select("id", F.struct(*order).alias("order")), [F.col("order")]).select("id", F.col("place").alias("new_id"))


def renumber(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by mapping (id, new_id)."""
    left = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("a"))
    right = mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("b"))
    return edges.join(left, "src").join(right, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def permutation(spark: SparkSession, num_vertices: int, seed: int = 0) -> DataFrame:
    """(id, new_id): a random permutation of 0 .. num_vertices - 1 that the seed fixes."""
    return dense_ids(spark.range(num_vertices), [F.xxhash64(F.lit(seed), "id"), F.col("id")])


def remap_vertex_ids(edges: DataFrame, num_vertices: int, seed: int = 0) -> DataFrame:
    """Edges under a `permutation` of the vertices."""
    return renumber(edges, permutation(edges.sparkSession, num_vertices, seed))


def compress_vertex_ids(edges: DataFrame, permute: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping) with the ids that occur numbered from 0, in order or permuted."""
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id")] if permute else [F.col("id")]
    mapping = dense_ids(endpoints(edges), order)
    return renumber(edges, mapping), mapping
