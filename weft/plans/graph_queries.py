"""Registered graph queries and their SQL twins.

The graph is that of co-purchases: parts that share an order, over all order lines. All part keys 0 .. V - 1 are
vertices, so parts never bought together are isolated. Recursive twins run to their fixpoint, or for as many steps as
the algorithm's own parameters allow.
"""

from __future__ import annotations

import contextlib
import io
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import threefry
from weft.functions.lcg import LCG, pick_random_vertex
from weft.functions.stats import trial_stats
from weft.functions.storage import shared_dir
from weft.operators import components, prep, triangles
from weft.operators.bfs import BFS
from weft.operators.copurchase import pairs
from weft.operators.graph import Graph
from weft.operators.ktruss import KTruss
from weft.operators.pagerank import PageRank
from weft.plans import runner
from weft.sources import edge_files, rmat

NODELETS, MANY_NODELETS = 8, 1024
RMAT_NAMES = ("graph500-scale12", "0.45-0.25-0.15-0.15-64K-4K.rmat", "0.5-0.5-0.5-0.5-1K-1K.rmat", "graph")


def copurchase_edges(spark: SparkSession, sf_dir: str, quantity: float | None = None) -> DataFrame:
    """Pairs of parts that share an order, over all lines; or over those of at least a quantity, for small fixtures."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if quantity is not None:
        lines = lines.filter(F.col("l_quantity") >= quantity)
    return pairs(lines.select(F.col("l_orderkey").cast("long"), F.col("l_partkey").cast("long")).dropna())


def copurchase(spark: SparkSession, sf_dir: str, quantity: float | None = None) -> Graph:
    return Graph(copurchase_edges(spark, sf_dir, quantity), spark.read.parquet(f"{sf_dir}/part.parquet").count())


#: By name: functions of a graph, and the queries of (spark, sf_dir) that apply them.
OPERATIONS: dict = {}
QUERIES: dict = {}


def _register(name: str, f) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(copurchase(spark, sf_dir))

    query.__name__, query.__doc__ = name, f.__doc__
    OPERATIONS[name], QUERIES[name] = f, query


def _query(f):
    """Register a function of a graph as a query."""
    _register(f.__name__, f)
    return f


def _row(g: Graph, schema: str, *values) -> DataFrame:
    return g.spark.createDataFrame([values], schema)


# -- the graph ---------------------------------------------------------------------------------------------------


@_query
def edges_canonical(g):
    return g.edges


@_query
def graph_size(g):
    return _row(g, "num_vertices long, num_edges long", g.num_vertices, g.num_edges)


@_query
def vertex_degree(g):
    return g.degrees


@_query
def adjacency_lists(g):
    return g.adjacency_lists().select("id", F.array_join(F.col("neighbors").cast("array<string>"), " ").alias("neighbors"))


@_query
def adjacency_by_nodelet(g):
    """Lists sorted by the neighbour's nodelet."""
    return g.adjacency_lists(F.col("dst") % NODELETS).select("id", F.array_join(F.col("neighbors").cast("array<string>"), " ").alias("neighbors"))


@_query
def dump_graph(g):
    return g.dump()


@_query
def dump_oriented(g):
    return g.dump(oriented=True)


@_query
def dump_edges(g):
    return g.dump_edges()


@_query
def degree_distribution(g):
    return g.degree_distribution()


def _histogram(g: Graph, nodelets: int) -> DataFrame:
    return g.edge_distribution(nodelets).select("kind", "place", F.round("share", 9).alias("share"), "bar")


@_query
def nodelet_histogram(g):
    return _histogram(g, NODELETS)


@_query
def chassis_histogram(g):
    return _histogram(g, MANY_NODELETS)


@_query
def graph_check(g):
    return g.check()


@_query
def first_higher_neighbor(g):
    return g.find_neighbor(F.col("dst") > F.col("src"))


@_query
def neighbor_degree_sum(g):
    return g.aggregate_messages(g.degrees, F.col("degree"), F.sum)


@_query
def neighbor_reducers(g):
    """Each built-in reducer over the neighbours' degrees."""
    all_of = lambda x: F.struct(F.sum(x).alias("total"), F.bit_and(x).alias("all_bits"), F.bit_or(x).alias("any_bits"), F.bit_xor(x).alias("odd_bits"), F.min(x).alias("least"), F.max(x).alias("most"))
    return g.aggregate_messages(g.degrees, F.col("degree"), all_of).select("id", "value.*")


@_query
def mapped_vertices(g):
    return g.map_vertices(parity=F.col("degree") % 2, far=F.col("degree") + F.col("id"))


@_query
def mapped_edges(g):
    return g.map_edges(gap=F.col("dst") - F.col("src"))


@_query
def edges_among_neighbors_in_id(g):
    """Which of the pairs (v + 1, v) are edges."""
    return g.edge_exists(g.vertices.select((F.col("id") + 1).alias("src"), F.col("id").alias("dst")))


def _thirds(g: Graph, wanted: int) -> DataFrame:
    return g.edges.filter((F.col("src") + F.col("dst")) % 3 == wanted)


@_query
def edges_removed(g):
    """A third of the edges removed, some of them named the other way round."""
    gone = _thirds(g, 0).select(F.when(F.col("src") % 2 == 0, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(F.col("src") % 2 == 0, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    return g.remove_edges(gone).adj


@_query
def edges_inserted(g):
    """All but a third of the edges, and that third inserted."""
    return Graph(g.edges.exceptAll(_thirds(g, 1)), g.num_vertices).insert_edges(_thirds(g, 1)).degrees


# -- preparation ---------------------------------------------------------------------------------------------------


@_query
def flipped_edges(g):
    mixed = g.edges.select(F.when(F.col("src") % 2 == 0, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("src") % 2 == 0, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return prep.flip_edges(mixed)


@_query
def sorted_edges(g):
    """Edges with their number in the sorted list."""
    ranked = prep.sort_edges(g.edges.repartition(8, "dst")).withColumn("order", F.monotonically_increasing_id())
    return prep.placed(ranked, [F.col("order")]).drop("order")


@_query
def deduplicated_edges(g):
    return prep.dedup_edges(g.edges.unionAll(g.edges.filter("src % 2 = 0")))


@_query
def self_edges_dropped(g):
    return prep.drop_self_edges(g.edges.unionAll(g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))))


@_query
def max_vertex(g):
    return _row(g, "max_id long", prep.max_vertex_id(g.edges))


@_query
def unique_vertices(g):
    return _row(g, "vertices long", prep.count_unique_vertex_ids(g.edges))


@_query
def shuffled_edges(g):
    """Whether shuffling keeps all edges and moves most of them."""
    new = prep.placed(prep.shuffle_edges(g.edges, 5).withColumn("order", F.monotonically_increasing_id()), [F.col("order")]).select("src", "dst", F.col("place").alias("now"))
    both = prep.placed(g.edges, [F.col("src"), F.col("dst")]).join(new, ["src", "dst"])
    return both.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("now").alias("places"), (2 * F.count_if(F.col("now") != F.col("place")) > F.count(F.lit(1))).alias("moved"))


@_query
def compress_ids(g):
    return prep.compress_vertex_ids(g.edges)[0]


@_query
def compress_permuted(g):
    """Degrees under permuted dense ids, told by the old ones."""
    edges, mapping = prep.compress_vertex_ids(g.edges, permute=True, seed=4)
    return mapping.join(Graph(edges, mapping.count()).degrees.withColumnRenamed("id", "new_id"), "new_id").select("id", "degree")


@_query
def remap_check(g):
    """Degrees in the remapped graph, told by the old ids."""
    other = Graph(prep.remap_vertex_ids(g.edges, g.num_vertices, 3), g.num_vertices)
    return prep.permutation(g.spark, g.num_vertices, 3).join(other.degrees.withColumnRenamed("id", "new_id"), "new_id").select("id", "degree")


@_query
def permutation_check(g):
    p = prep.permutation(g.spark, g.num_vertices, 3)
    return p.agg(F.count_distinct("id").alias("old_ids"), F.count_distinct("new_id").alias("new_ids"), F.min("new_id").alias("least"), F.max("new_id").alias("most"), (2 * F.count_if(F.col("id") != F.col("new_id")) > F.count(F.lit(1))).alias("moved"))


# -- triangles, components, PageRank ---------------------------------------------------------------------------------


@_query
def tc_summary(g):
    return triangles.summary(g)


@_query
def two_paths(g):
    return triangles.two_paths(g)


@_query
def edge_support(g):
    return triangles.edge_support(g)


@_query
def tc_check(g):
    return triangles.check(g)


def _labels(g: Graph) -> DataFrame:
    return components.component_labels(g.vertices, g.edges)


@_query
def cc_labels(g):
    return _labels(g)


@_query
def cc_propagated(g):
    return components.connected_components(g)[0]


@_query
def cc_sizes(g):
    return components.sizes(_labels(g))


@_query
def cc_summary(g):
    return components.sizes(_labels(g)).agg(F.count(F.lit(1)).alias("num_components"), F.max("size").alias("largest"))


@_query
def cc_iterations(g):
    return _row(g, "num_iters long", components.connected_components(g)[1])


@_query
def cc_ranges(g):
    return components.ranges(_labels(g))


@_query
def cc_check(g):
    return components.check(_labels(g), g.adj)


@_query
def pagerank_5(g):
    return PageRank(g, max_iters=5).scores.select("id", F.round("score", 9).alias("score"))


@_query
def pagerank_converged(g):
    r = PageRank(g)
    return r.scores.select("id", F.round("score", 9).alias("score"), F.lit(r.num_iters).alias("num_iters"), F.lit(r.supersteps).alias("supersteps"))


@_query
def pagerank_check(g):
    r = PageRank(g)
    return _row(g, "converged boolean, residual double", r.residual() < r.epsilon, round(r.residual(), 12))


@_query
def pagerank_score(g):
    """The score of one vertex."""
    return _row(g, "id long, score double", _source(g), round(PageRank(g, max_iters=5).score(_source(g)), 9))


# -- breadth-first search ----------------------------------------------------------------------------------------------


def _source(g: Graph) -> int:
    return LCG()() % g.num_vertices


@_query
def random_vertices(g):
    """The first vertices that the generator picks."""
    rng = LCG()
    return g.spark.createDataFrame([(k, pick_random_vertex(g, rng)) for k in range(4)], "pick int, id long")


def _levels(g: Graph, strategy: str) -> DataFrame:
    return BFS(g, _source(g), strategy).result().select("id", "depth")


for _name, _strategy in (("td", "migrating_threads"), ("rw", "remote_writes"), ("beamer", "beamer_hybrid"), ("rwhybrid", "remote_writes_hybrid")):
    _register(f"bfs_levels_{_name}", lambda g, s=_strategy: _levels(g, s))


@_query
def bfs_parents(g):
    return BFS(g, _source(g)).result().select("id", "parent")


@_query
def bfs_level_hist(g):
    return BFS(g, _source(g)).levels.groupBy("depth").agg(F.count(F.lit(1)).alias("vertices"))


@_query
def bfs_frontier(g):
    """What the queue held at each level, by nodelet."""
    return BFS(g, _source(g)).frontier(NODELETS)


@_query
def bfs_frontier_sizes(g):
    return BFS(g, _source(g)).frontier_sizes(NODELETS)


@_query
def bfs_traversed(g):
    return _row(g, "traversed long", BFS(g, _source(g)).traversed_edges())


@_query
def bfs_trace(g):
    return BFS(g, _source(g)).trace_frame()


@_query
def bfs_trace_rwhybrid(g):
    return BFS(g, _source(g), "remote_writes_hybrid").trace_frame()


@_query
def bfs_paths(g):
    return BFS(g, _source(g)).paths()


@_query
def bfs_check(g):
    return BFS(g, _source(g)).check()


# -- k-truss -------------------------------------------------------------------------------------------------------------


@_query
def ktruss_edges(g):
    return KTruss(g).edges


@_query
def ktruss_k4(g):
    return KTruss(g, 4).edges.filter("kte >= 4").select("src", "dst")


@_query
def ktruss_summary(g):
    return KTruss(g).summary()


@_query
def ktruss_passes(g):
    k = KTruss(g)
    return _row(g, "max_k long, num_iters long", k.max_k, k.num_iters)


@_query
def ktruss_klimit(g):
    return KTruss(g, 8).summary()


@_query
def ktruss_check(g):
    return KTruss(g).check()


# -- files, generator, programs ----------------------------------------------------------------------------------------


def _scratch(g: Graph, name: str) -> str:
    """A file name in the shared folder that tasks and driver can open."""
    folder = shared_dir(g.spark).removeprefix("file://").removeprefix("file:")
    Path(folder).mkdir(parents=True, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}{name}"


def _text(g: Graph, lines: DataFrame, name: str) -> str:
    path = f"{shared_dir(g.spark)}/{uuid.uuid4().hex}{name}"
    lines.write.text(path)
    return path


def _el64(g: Graph) -> str:
    edge_files.write_el64(g.edges, path := _scratch(g, ".el64"), g.num_vertices)
    return path


@_query
def el64_roundtrip(g):
    return edge_files.read_el64(g.spark, _el64(g))[0]


@_query
def el64_local(g):
    """The file read in one task, with each edge's place in it."""
    return edge_files.read_el64(g.spark, _el64(g), partitioned=False, ordinal=True)[0]


@_query
def el64_header(g):
    head = edge_files.read_header(_el64(g))
    return _row(g, "num_vertices long, num_edges long, format string, is_deduped boolean", head.num_vertices, head.num_edges, head.format, head.is_deduped)


@_query
def fileset_roundtrip(g):
    edge_files.write_fileset(g.edges, path := _scratch(g, ".set"), NODELETS, g.num_vertices)
    return edge_files.read_fileset(g.spark, path)[0]


@_query
def shard_placement(g):
    """Where the edges of an el64 file are in its file set."""
    edge_files.shard_file(g.spark, path := _el64(g), NODELETS)
    return edge_files.read_fileset(g.spark, path, ordinal=True)[0].select((F.col("place") % NODELETS).alias("shard"), F.floor(F.col("place") / NODELETS).alias("at"), "src", "dst")


@_query
def mtx_roundtrip(g):
    edge_files.write_mtx(g.edges, path := _scratch(g, ".mtx"), g.num_vertices)
    return edge_files.read_mtx(g.spark, "file://" + path)[0]


@_query
def mtx_lines(g):
    """The lines of a Matrix Market file, without its head."""
    edge_files.write_mtx(g.edges, path := _scratch(g, ".mtx"), g.num_vertices)
    return g.spark.read.text("file://" + path).filter("value not like '\\%%' and value like '% 1'").select(F.col("value").alias("line"))


@_query
def mtx_entries(g):
    """A general matrix with values, written and read again."""
    entries = g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("dst") - F.col("src") + 0.5).alias("value"), F.lit(0.0).alias("imaginary"))
    edge_files.write_matrix(entries, path := _scratch(g, ".mtx"), g.num_vertices, g.num_vertices, edge_files.Banner("coordinate", "real", "general"))
    return edge_files.read_matrix(g.spark, f"file://{path}")[0]


def _snap_lines(g: Graph) -> DataFrame:
    return g.edges.select(F.concat_ws("\t", F.col("dst").cast("string"), F.col("src").cast("string"), F.lit("x")).alias("line"))


def _tsv_lines(g: Graph) -> DataFrame:
    return g.edges.select(F.concat_ws("\t", F.col("dst").cast("string"), F.col("src").cast("string"), F.lit("1")).alias("line"))


@_query
def snap_txt(g):
    return edge_files.read_snap(g.spark, _text(g, _snap_lines(g), ".txt"))[0]


@_query
def tsv_import(g):
    return edge_files.read_tsv(g.spark, _text(g, _tsv_lines(g), ".tsv"))[0]


@_query
def converted_files(g):
    """Files of three formats, told apart by suffix, converted to el64 and read again."""
    edge_files.write_mtx(g.edges, mtx := _scratch(g, ".mtx"), g.num_vertices)
    out = None
    for kind, path in (("mtx", "file://" + mtx), ("txt", _text(g, _snap_lines(g), ".txt")), ("tsv", _text(g, _tsv_lines(g), ".tsv"))):
        one = edge_files.load_graph(g.spark, edge_files.convert(g.spark, path, _scratch(g, ".el64")))[0].select(F.lit(kind).alias("kind"), "src", "dst")
        out = one if out is None else out.unionAll(one)
    return out


def rmat_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of graphs, parsed and validated."""
    rows = []
    for name in RMAT_NAMES:
        try:
            a = rmat.RmatArgs.parse(name)
            rows.append((name, True, a.a, a.b, a.c, a.d, a.num_edges, a.num_vertices))
        except ValueError:
            rows.append((name, False, None, None, None, None, None, None))
    return spark.createDataFrame(rows, "name string, valid boolean, a double, b double, c double, d double, num_edges long, num_vertices long")


def rmat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rmat.rmat_dataset(spark, rmat.RmatArgs.parse(RMAT_NAMES[0]))


def rmat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges of the generator: how many there are, out of range, self-edges; and whether quadrants come as often as they should."""
    args = rmat.RmatArgs.parse(RMAT_NAMES[0])
    half, quadrant = args.num_vertices // 2, lambda src, dst: ((F.col("src") >= half) == src) & ((F.col("dst") >= half) == dst)
    near = lambda p, src, dst: F.abs(F.avg(quadrant(src, dst).cast("double")) - p) < 0.02
    fair = near(args.a, False, False) & near(args.b, False, True) & near(args.c, True, False) & near(args.d, True, True)
    outside = (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= args.num_vertices)
    return rmat.rmat_edges(spark, args).agg(F.count(F.lit(1)).alias("edges"), F.count_if(outside).alias("outside"), F.count_if(F.col("src") == F.col("dst")).alias("self_edges"), fair.alias("fair"))


def lcg_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of the generator, each after a skip."""
    return spark.createDataFrame([(k, str(LCG(k)())) for k in range(40)], "step int, draw string")


def counter_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of the counter-based generator, the second half after a skip."""
    whole, skipped = threefry.Stream(7), threefry.Stream(7)
    skipped.discard(27)
    draws = [*whole.draws(27).tolist(), *skipped.draws(37).tolist()]
    return spark.createDataFrame(list(enumerate(draws)), "place int, draw long")


def trial_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_stats(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice").select(*[F.round(c, 4).alias(c) for c in ("sum", "mean", "hmean", "stddev", "min", "max")])


QUERIES |= {"rmat_arguments": rmat_arguments, "rmat_edges": rmat_edges, "rmat_check": rmat_check, "lcg_draws": lcg_draws, "counter_draws": counter_draws, "trial_stats": trial_statistics}


@_query
def programs(g):
    """Exit codes of the command line's programs on a file, with all checks on."""
    path, rows = _el64(g), []
    for name, *more in (("bfs", "--algorithm", "remote_writes"), ("components",), ("pagerank",), ("triangle_count",), ("ktruss", "--k_limit", "4"), ("combined", "--num_trials", "1")):
        with contextlib.redirect_stdout(io.StringIO()):
            rows.append((name, runner.main([name, "--graph_filename", path, "--check_graph", "--check_results", *more], g.spark)))
    return g.spark.createDataFrame(rows, "program string, code int")


@_query
def run_all(g):
    return runner.run_all(g)


def _sql(body: str, more: str = "") -> str:
    return f"""with recursive l as (select l_orderkey o, l_partkey p from lineitem),
e as materialized (select distinct a.p src, b.p dst from l a join l b on a.o = b.o and a.p < b.p),
adj as materialized (select src, dst from e union all select dst, src from e),
v as (select count(*)::bigint n from part), ids as (select unnest(range(0, (select n from v)))::bigint id),
deg as materialized (select id, count(dst) degree from ids left join adj on src = id group by id){more}
{body}"""


_BFS = """,
s as (select (6364136223846793006 % (select n from v))::bigint root),
b(id, depth) using key (id) as (select root, 0 from s union
  select adj.dst, min(b.depth) + 1 from b join adj on adj.src = b.id left join recurring.b seen on seen.id = adj.dst where seen.id is null group by adj.dst),
lv as materialized (select id, depth::int depth from b),
pa as materialized (select x.id, x.depth, case when x.depth = 0 then x.id else min(y.id) end parent from lv x left join adj on adj.src = x.id left join lv y on y.id = adj.dst and y.depth = x.depth - 1 group by x.id, x.depth)"""
_CC = """,
c(id, label) using key (id) as (select id, id from ids union
  select adj.dst, min(c.label) from c join adj on adj.src = c.id join recurring.c old on old.id = adj.dst where c.label < old.label group by adj.dst),
cc as materialized (select id, label component from c)"""
_TRI = """,
t as materialized (select a.dst u, a.src v, b.src w from e a join e b on b.dst = a.src join e c on c.dst = a.dst and c.src = b.src)"""
#: An edge's rows are the passes that it was in; a pass that removes nothing raises k.
_TRUSS = _TRI + """,
sides as materialized (select u hi, v lo, v h2, w l2, u h3, w l3 from t union all select v, w, u, v, u, w from t union all select u, w, u, v, v, w from t),
k(step, k, hi, lo) as (select 0, 3, dst, src from e union all
  select step + 1, case when worst < k - 2 then k else k + 1 end, hi, lo from (select *, min(n) over () worst from
    (select x.step, x.k, x.hi, x.lo, coalesce(m.n, 0) n from k x left join (select y.hi, y.lo, count(*) n from sides y join k a on a.hi = y.h2 and a.lo = y.l2 join k b on b.hi = y.h3 and b.lo = y.l3 group by y.hi, y.lo) m
      on m.hi = x.hi and m.lo = x.lo where x.k <= {limit})) where n >= k - 2),
kt as materialized (select hi src, lo dst, (max(k) - 1)::int kte from k group by hi, lo)"""
_TRUSS_ALL = _TRUSS.replace("{limit}", "9223372036854775807")


def _truss_sizes(limit: int | None = None) -> str:
    # The limit is reached if edges are left when its pass begins, even if they go in it.
    top = f"(select case when max(kte) >= {limit} - 1 then {limit} else max(kte) end from kt)" if limit else "(select max(kte) from kt)"
    return f"""select ks.k::int k, (select count(*) from (select id, max(kte) top from (select src id, kte from kt union all select dst, kte from kt) group by id) where top >= ks.k) vertices,
(select count(*) from kt where kte >= ks.k) edges from (select unnest(range(2, {top} + 1)) k) ks"""


#: Levels with their size and their degrees' sum; then one row a step, as the strategy's switch has it.
_TRACE = _BFS + """,
f as materialized (select depth, count(*)::bigint size, sum(degree)::bigint ends from lv join deg using (id) group by depth),
w(step, dir, size, ends, scout, checks, inner_loop) as (
  select 0, '', 1::bigint, 0::bigint, (select ends from f where depth = 0), 2 * (select count(*) from e)::bigint, false union all
  select step + 1, case when bottom then '{other}' else 'TD' end, size2, ends2,
    case when not bottom then ends2 when again then scout else 1 end, case when bottom then checks else checks - scout end, bottom and again
  from (select *, size2 > 0 and (size2 >= size or size2 > (select n from v) // 18) again
    from (select w.*, inner_loop or scout > checks // 15 bottom, coalesce(f.size, 0) size2, coalesce(f.ends, 0) ends2 from w left join f on f.depth = w.step + 1 where w.size > 0)))"""
_RANK = """,
pr(step, id, score, change) as (select 0, id, 1.0::double / (select n from v), 1.0::double from ids union all
  select step + 1, id, fresh, sum(abs(fresh - score)) over () from (select p.step, p.id, p.score, 0.15::double / (select n from v) + 0.85::double * coalesce(sum(q.score / d.degree), 0) fresh
    from pr p left join adj on adj.src = p.id left join pr q on q.id = adj.dst left join deg d on d.id = adj.dst where p.step < {steps} and p.change >= {least} group by p.step, p.id, p.score))"""
_FIVE, _CONVERGED = _RANK.format(steps=5, least=0), _RANK.format(steps=20, least="1e-5")
_LAST = ",\nlast as (select max(step) n, max_by(change, step) change from pr)"
_EDGES = _sql("select src, dst from e")
_LEVELS = _sql("select ids.id, coalesce(depth, -1)::int depth from ids left join lv on lv.id = ids.id", _BFS)
_TWO = "(select coalesce(sum(hi * lo), 0)::bigint from (select src, count(*) filter (dst > src) hi, count(*) filter (dst < src) lo from adj group by src)) num_twopaths"
_DENSE = ",\nm as (select id, row_number() over (order by id) - 1 n from deg where degree > 0)"
_COMPRESSED = "select a.n src, b.n dst from e join m a on a.id = src join m b on b.id = dst"
_DEGREES = _sql("select id, degree from deg")
#: Pointer jumping to the end: chains are halved as often as a path through all vertices would need, up to 2 ** 24 of them.
_JUMPS = ",\n".join(f"j{i + 1} as materialized (select a.id, b.c from j{i} a join j{i} b on b.id = a.c)" for i in range(24))


def _histogram_sql(kind: str, nodelets: int, width: int) -> str:
    return _sql(f"select '{kind}' kind, place, round(share, 9) share, floor(10 * share / max(share) over ())::bigint bar from (select (id % {nodelets}) // {width} place, sum(degree)::double / (2.0 * (select count(*) from e)) share from deg group by 1)")


#: The published rounds of the counter-based generator, a row each, on words modulo 2 ** 64 held in wider ones; key 7.
_COUNTER = """with recursive turns(nth, e, o) as (values (0, 14, 16), (1, 52, 57), (2, 23, 40), (3, 5, 37), (4, 25, 33), (5, 46, 12), (6, 58, 22), (7, 32, 32)),
keys as (select [7::uhugeint, 0::uhugeint, 0::uhugeint, 0::uhugeint, 2004413935125273125::uhugeint] k, 18446744073709551616::uhugeint m),
s(r, c, x0, x1, x2, x3) as (select 0, c, (c + 7)::uhugeint, 0::uhugeint, 0::uhugeint, 0::uhugeint from range(8) t(c) union all
  select r + 1, c, case when r % 4 = 3 then (y0 + k[(r // 4 + 1) % 5 + 1]) % m else y0 end, case when r % 4 = 3 then (y1 + k[(r // 4 + 2) % 5 + 1]) % m else y1 end,
    case when r % 4 = 3 then (y2 + k[(r // 4 + 3) % 5 + 1]) % m else y2 end, case when r % 4 = 3 then (y3 + k[(r // 4 + 4) % 5 + 1] + (r // 4 + 1)::uhugeint) % m else y3 end
  from (select *, xor(case when r % 2 = 0 then t1 else u1 end, case when r % 2 = 0 then y0 else y2 end) y1, xor(case when r % 2 = 0 then u3 else t3 end, case when r % 2 = 0 then y2 else y0 end) y3
    from (select *, (x0 + case when r % 2 = 0 then x1 else x3 end) % m y0, (x2 + case when r % 2 = 0 then x3 else x1 end) % m y2,
        (x1 * pe) % m + x1 // qe t1, (x1 * po) % m + x1 // qo u1, (x3 * pe) % m + x3 // qe t3, (x3 * po) % m + x3 // qo u3
      from (select s.*, k, m, pow2[e + 1] pe, pow2[65 - e] qe, pow2[o + 1] po, pow2[65 - o] qo from s join turns on nth = r % 8, keys, (select list(1::uhugeint << i::uhugeint order by i) pow2 from range(65) p(i)) where r < 20))))
select (c * 8 + j)::int place, (case when j % 2 = 0 then x % 4294967296::uhugeint else x // 4294967296::uhugeint end)::bigint draw
from (select c, unnest([0, 1, 2, 3, 4, 5, 6, 7]) j, unnest([x0, x0, x1, x1, x2, x2, x3, x3]) x from s where r = 20)"""

ORACLES = {
    "counter_draws": _COUNTER,
    **dict.fromkeys(("edges_canonical", "el64_roundtrip", "fileset_roundtrip", "mtx_roundtrip", "tsv_import", "flipped_edges", "deduplicated_edges", "self_edges_dropped"), _EDGES),
    **dict.fromkeys(("sorted_edges", "el64_local"), _sql("select src, dst, row_number() over (order by src, dst) - 1 place from e")),
    "graph_size": _sql("select (select n from v) num_vertices, (select count(*) from e) num_edges"),
    "el64_header": _sql("select (select n from v) num_vertices, (select count(*) from e) num_edges, 'el64' format, true is_deduped"),
    "shard_placement": _sql(f"select j % {NODELETS} shard, j // {NODELETS} as at, src, dst from (select src, dst, row_number() over (order by src, dst) - 1 j from e)"),
    "mtx_lines": _sql("select (dst + 1) || ' ' || (src + 1) || ' 1' line from e"),
    "mtx_entries": _sql("select src as row, dst col, (dst - src) + 0.5::double as value, 0::double imaginary from e"),
    "converted_files": _sql(f"select 'mtx' kind, src, dst from e union all select 'tsv', src, dst from e union all select 'txt', src, dst from ({_COMPRESSED})", _DENSE),
    **dict.fromkeys(("vertex_degree", "remap_check", "edges_inserted"), _DEGREES),
    "compress_permuted": _sql("select id, degree from deg where degree > 0"),
    "permutation_check": _sql("select n old_ids, n new_ids, 0::bigint least, n - 1 most, true moved from v"),
    "shuffled_edges": _sql("select count(*) edges, count(*) places, true moved from e"),
    "max_vertex": _sql("select max(dst) max_id from e"),
    "unique_vertices": _sql("select count(*) vertices from deg where degree > 0"),
    "mapped_vertices": _sql("select id, degree, degree % 2 parity, degree + id far from deg"),
    "mapped_edges": _sql("select src, dst, dst - src gap from e"),
    "edges_among_neighbors_in_id": _sql("select dst src, src dst from e where dst = src + 1"),
    "edges_removed": _sql("select src, dst from adj where (src + dst) % 3 <> 0"),
    "adjacency_lists": _sql("select src id, string_agg(dst::varchar, ' ' order by dst) neighbors from adj group by src"),
    "adjacency_by_nodelet": _sql(f"select src id, string_agg(dst::varchar, ' ' order by dst % {NODELETS}, dst) neighbors from adj group by src"),
    "dump_graph": _sql("select src id, src::varchar || ' -> ' || string_agg(dst::varchar, ' ' order by dst) line from adj group by src"),
    "dump_oriented": _sql("select dst id, dst::varchar || ' -> ' || string_agg(src::varchar, ' ' order by src) line from e group by dst"),
    "dump_edges": _sql("select src || ' -> ' || dst line from e"),
    "degree_distribution": _sql("select degree, count(*) vertices from deg group by degree"),
    "nodelet_histogram": _histogram_sql("nodelet", NODELETS, 1),
    "chassis_histogram": _histogram_sql("chassis", MANY_NODELETS, 64),
    "graph_check": _sql("select (select count(*) from e anti join adj using (src, dst)) missing_forward, (select count(*) from (select dst src, src dst from e) r anti join adj using (src, dst)) missing_backward, (select count(*) from (select 1 from adj group by src, dst having count(*) > 1)) duplicates"),
    "first_higher_neighbor": _sql("select src id, min(dst) neighbor from adj where dst > src group by src"),
    "neighbor_degree_sum": _sql("select src id, sum(degree)::bigint as value from adj join deg on deg.id = adj.dst group by src"),
    "neighbor_reducers": _sql("select src id, sum(degree)::bigint total, bit_and(degree) all_bits, bit_or(degree) any_bits, bit_xor(degree) odd_bits, min(degree) least, max(degree) most from adj join deg on deg.id = adj.dst group by src"),
    **dict.fromkeys(("compress_ids", "snap_txt"), _sql(_COMPRESSED, _DENSE)),
    **dict.fromkeys(("tc_summary", "tc_check"), _sql(f"select (select count(*) from t) num_triangles, {_TWO}", _TRI)),
    "two_paths": _sql(f"select {_TWO}"),
    "edge_support": _sql("select e.dst src, e.src dst, count(x.a) support from e left join (select u a, v b from t union all select v, w from t union all select u, w from t) x on x.a = e.dst and x.b = e.src group by 1, 2", _TRI),
    **dict.fromkeys(("cc_labels", "cc_propagated"), _sql("select id, component from cc", _CC)),
    "cc_sizes": _sql("select component, count(*) size from cc group by component", _CC),
    "cc_summary": _sql("select count(*) num_components, max(size) largest from (select count(*) size from cc group by component)", _CC),
    "cc_iterations": _sql("select max(it)::bigint num_iters from g", f""",
g(it, id, comp, moved) as (select 0, id, id, true from ids union all
  select it + 1, id, c, bool_or(c <> comp) over () from (
    with j0 as materialized (select x.it, x.id, x.comp, least(x.comp, min(y.comp)) c from g x left join adj on adj.src = x.id left join g y on y.id = adj.dst where x.moved group by x.it, x.id, x.comp),
    {_JUMPS}
    select j0.it, j0.id, j0.comp, j24.c from j0 join j24 using (id)))"""),
    "cc_ranges": _sql("select component, 'Component ' || component || ': ' || string_agg(case when lo = hi then lo::varchar else lo || '-' || hi end, ', ' order by lo) line from (select component, min(id) lo, max(id) hi from (select component, id, id - row_number() over (partition by component order by id) island from cc) group by component, island) group by component", _CC),
    "cc_check": _sql("select count(*) filter (a.component <> b.component) split_edges, (select count(*) from (select component from cc group by component having min(id) <> component)) wrong_labels from adj join cc a on a.id = src join cc b on b.id = dst", _CC),
    "pagerank_5": _sql("select id, round(score, 9) score from pr where step = 5", _FIVE),
    "pagerank_score": _sql("select id, round(score, 9) score from pr where step = 5 and id = (6364136223846793006 % (select n from v))::bigint", _FIVE),
    "pagerank_converged": _sql("select id, round(score, 9) score, (case when last.change < 1e-5 then last.n - 1 else last.n end)::int num_iters, last.n::int supersteps from pr, last where step = last.n", _CONVERGED + _LAST),
    "pagerank_check": _sql("select residual < 1e-5 converged, round(residual, 12) residual from (select sum(abs(fresh - score)) residual from (select p.id, p.score, 0.15::double / (select n from v) + 0.85::double * coalesce(sum(q.score / d.degree), 0) fresh from fin p left join adj on adj.src = p.id left join fin q on q.id = adj.dst left join deg d on d.id = adj.dst group by p.id, p.score))", _CONVERGED + _LAST + ",\nfin as (select pr.* from pr, last where step = last.n)"),
    "random_vertices": _sql("select (row_number() over (order by step) - 1)::int pick, id from (select step, (draw % (select n::uhugeint from v))::bigint id from draws) join deg using (id) where degree > 0 order by step limit 4", """,
draws(step, draw) as (select 0, 6364136223846793006::uhugeint union all select step + 1, (draw * 6364136223846793005::uhugeint + 1) % 18446744073709551616::uhugeint from draws where step < 400)"""),
    **{f"bfs_levels_{x}": _LEVELS for x in ("td", "rw", "beamer", "rwhybrid")},
    "bfs_parents": _sql("select ids.id, coalesce(parent, -1) parent from ids left join pa on pa.id = ids.id", _BFS),
    "bfs_level_hist": _sql("select depth, count(*) vertices from lv group by depth", _BFS),
    "bfs_frontier": _sql(f"select depth, id % {NODELETS} nodelet, id from lv", _BFS),
    "bfs_frontier_sizes": _sql(f"select depth, id % {NODELETS} nodelet, count(*) size from lv group by 1, 2", _BFS),
    "bfs_traversed": _sql("select (sum(degree) // 2)::bigint traversed from lv join deg using (id)", _BFS),
    "bfs_trace": _sql("select step, dir direction, size frontier, ends scout from w where step > 0", _TRACE.format(other="BU")),
    "bfs_trace_rwhybrid": _sql("select step, dir direction, size frontier, ends scout from w where step > 0", _TRACE.format(other="RW")),
    "bfs_paths": _sql("select id, path from w", _BFS + ",\nw(id, path) as (select id, id::varchar from pa where depth = 0 union all select pa.id, pa.id || ' <- ' || w.path from w join pa on pa.parent = w.id and pa.depth > 0)"),
    "bfs_check": _sql("select (select count(*) from pa join lv up on up.id = pa.parent where pa.depth > 0 and up.depth <> pa.depth - 1) wrong_depth, (select count(*) from pa anti join adj on adj.src = pa.id and adj.dst = pa.parent where depth > 0) false_parent, (select count(*) from adj join lv a on a.id = src left join lv b on b.id = dst where b.depth is null or abs(a.depth - b.depth) > 1) skipped, (select count(*) from pa, s where id = root and (parent <> root or depth <> 0)) wrong_root", _BFS),
    "ktruss_edges": _sql("select src, dst, kte from kt", _TRUSS_ALL),
    "ktruss_summary": _sql(_truss_sizes(), _TRUSS_ALL),
    "ktruss_passes": _sql("select (max(k) - 1)::bigint max_k, max(step) + 1 num_iters from k", _TRUSS_ALL),
    "ktruss_k4": _sql("select src, dst from kt where kte >= 4", _TRUSS.replace("{limit}", "4")),
    "ktruss_klimit": _sql(_truss_sizes(8), _TRUSS.replace("{limit}", "8")),
    "ktruss_check": _sql("select count(*) filter (n < kte - 2) unsupported, count(*) filter (up >= kte - 1) extendable from (select c.src, c.dst, c.kte, count(*) filter (least(a.kte, b.kte) >= c.kte) n, count(*) filter (least(a.kte, b.kte) > c.kte) up from kt c left join (sides y join kt a on a.src = y.h2 and a.dst = y.l2 join kt b on b.src = y.h3 and b.dst = y.l3) on y.hi = c.src and y.lo = c.dst group by c.src, c.dst, c.kte)", _TRUSS_ALL),
    "rmat_arguments": "select * from (values ('graph500-scale12', true, 0.57::double, 0.19::double, 0.19::double, 0.05::double, 65536::bigint, 4096::bigint), ('0.45-0.25-0.15-0.15-64K-4K.rmat', true, 0.45, 0.25, 0.15, 0.15, 65536, 4096), ('0.5-0.5-0.5-0.5-1K-1K.rmat', false, null, null, null, null, null, null), ('graph', false, null, null, null, null, null, null)) x(name, valid, a, b, c, d, num_edges, num_vertices)",
    "rmat_check": "select 65536::bigint edges, 0::bigint outside, 0::bigint self_edges, true fair",
    "lcg_draws": "with recursive d(step, draw) as (select 0, 6364136223846793006::uhugeint union all select step + 1, (draw * 6364136223846793005::uhugeint + 1) % 18446744073709551616::uhugeint from d where step < 39) select step, draw::varchar draw from d",
    "trial_stats": "select round(sum(p_retailprice), 4) as sum, round(avg(p_retailprice), 4) mean, round(count(*) / sum(1 / p_retailprice), 4) hmean, round(stddev_samp(p_retailprice), 4) stddev, round(min(p_retailprice), 4) as min, round(max(p_retailprice), 4) as max from part",
    "programs": "select unnest(['bfs', 'components', 'pagerank', 'triangle_count', 'ktruss', 'combined']) program, 0 code",
}
