"""RMAT graphs: arguments, and a generator that any partitioning reproduces.

Every random number is a hash of (seed, edge, attempt, level, draw), so an edge does not depend on where it is made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import prep

# The preset's quadrant probabilities and edges per vertex, and the size suffixes.
GRAPH500 = (0.57, 0.19, 0.19, 0.05)
EDGE_FACTOR = 16
SUFFIX = {"": 0, "K": 10, "M": 20, "G": 30, "T": 40}


@dataclass(frozen=True)
class RmatArgs:
    a: float
    b: float
    c: float
    d: float
    num_edges: int
    num_vertices: int

    @classmethod
    def parse(cls, name: str) -> RmatArgs:
        """`A-B-C-D-E-V.rmat` (E and V may end in K, M, G or T) or `graph500-scaleN`, with or without `.mtx`."""
        stem = name.rsplit("/", 1)[-1]
        if preset := re.fullmatch(r"graph500-scale(\d+)(\.mtx)?", stem):
            v = 1 << int(preset[1])
            return cls(*GRAPH500, EDGE_FACTOR * v, v).validated()
        number, size = r"(\d*\.?\d+)", r"(\d+)([KMGT]?)"
        if found := re.fullmatch(rf"{number}-{number}-{number}-{number}-{size}-{size}\.rmat", stem):
            return cls(*map(float, found.groups()[:4]), int(found[5]) << SUFFIX[found[6]], int(found[7]) << SUFFIX[found[8]]).validated()
        raise ValueError(f"not a graph description: {name}")

    def validated(self) -> RmatArgs:
        p = (self.a, self.b, self.c, self.d)
        if not all(0 <= x <= 1 for x in p) or abs(sum(p) - 1) > 1e-9:
            raise ValueError("probabilities must lie in [0, 1] and add up to 1")
        if self.num_edges < 0 or self.num_vertices < 0:
            raise ValueError("counts must not be negative")
        return self


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def rmat_edges(spark: SparkSession, args: RmatArgs, seed: int = 0, attempts: int = 64) -> DataFrame:
    """num_edges raw edges (src, dst). A self-edge is drawn again up to `attempts` times, then given another end at random.

    At each bit a quadrant is drawn; then each probability is scaled by (9.5 + u) / 10 and all are renormalised.
    """
    levels = max(0, args.num_vertices.bit_length() - 1)
    if args.num_edges and not levels:
        raise ValueError("edges need at least two vertices")
    p0 = F.array(*[F.lit(float(x)) for x in (args.a, args.b, args.c, args.d)])

    def one(attempt: Column) -> Column:
        def step(s: Column, level: Column) -> Column:
            u = lambda draw: _uniform(F.lit(seed), F.col("edge"), attempt, level, F.lit(draw))
            p, x = s["p"], u(0)
            low, left = x >= p[0] + p[1], ((x >= p[0]) & (x < p[0] + p[1])) | (x >= p[0] + p[1] + p[2])
            scaled = F.transform(p, lambda q, i: q * (9.5 + _uniform(F.lit(seed), F.col("edge"), attempt, level, i + 1)) / 10)
            whole = F.aggregate(scaled, F.lit(0.0), lambda m, q: m + q)
            return F.struct((s["src"] * 2 + low.cast("long")).alias("src"), (s["dst"] * 2 + left.cast("long")).alias("dst"), F.transform(scaled, lambda q: q / whole).alias("p"))

        start = F.struct(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), p0.alias("p"))
        bits = F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>")
        return F.aggregate(bits, start, step)

    rows = spark.range(args.num_edges).withColumnRenamed("id", "edge")
    made = rows.withColumn("e", one(F.lit(0)))
    # later attempts are worked out only for self-edges, one narrow step each
    redo = F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), F.col("e"), lambda s, t: F.when(s["src"] == s["dst"], one(t)).otherwise(s))
    found = made.select("edge", F.when(F.col("e.src") == F.col("e.dst"), redo).otherwise(F.col("e")).alias("e")).select("edge", "e.src", "e.dst")
    other = F.pmod(F.col("src") + 1 + F.pmod(F.xxhash64(F.lit(seed), F.col("edge"), F.lit(-1)), F.lit((1 << levels) - 1)), F.lit(1 << levels))
    return found.select("src", F.when(F.col("src") == F.col("dst"), other).otherwise(F.col("dst")).alias("dst"))


def rmat_dataset(spark: SparkSession, args: RmatArgs, seed: int = 0) -> DataFrame:
    """Canonical edges under permuted ids, in random order: what the generator tool writes."""
    edges = prep.canonical_edges(rmat_edges(spark, args, seed))
    return prep.shuffle_edges(prep.canonical_edges(prep.remap_vertex_ids(edges, args.num_vertices, seed)), seed)
