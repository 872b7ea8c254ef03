"""Operators over typed graphs held as node and edge tables.

Edges have src and dst; other columns are named by the caller. No operator gathers a graph in one
task: neighbourhoods are joins on the edge ends, closures are rounds of joins over a checked depth.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_edges(edges: DataFrame, keys: list[str], order: list[str], attributes: list[str]) -> DataFrame:
    """One edge per key: of each attribute the last value in the order that isn't null."""
    place = F.struct(*order)
    return edges.groupBy(*keys).agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), place)).alias(a) for a in attributes])


def entry_nodes(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Nodes that no edge ends at."""
    return nodes.join(edges.select(F.col("dst").alias(node)).distinct(), node, "left_anti")


def degrees(edges: DataFrame, node: str) -> DataFrame:
    """node, in_degree and out_degree; one pass over the edges, added up before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy(F.col("x.n").alias(node)).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def contiguous_ids(nodes: DataFrame, order: list[str], out: str, ranges: int = 64) -> DataFrame:
    """Ids 0, 1, 2, ... in the order, without one sorted task.

    Rows are dealt into ranges of the first order column by sampled quantiles; the range's offset is
    the number of rows before it, and rows are numbered inside their range.
    """
    first = order[0]
    cuts = nodes.select(F.percentile_approx(first, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    placed = nodes.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(first)))).drop("_cuts")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return numbered.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def remap_edges(edges: DataFrame, ids: DataFrame, old: str, new: str) -> DataFrame:
    """Edges between new ids; edges with an end that has none are dropped."""
    a = ids.select(F.col(old).alias("src"), F.col(new).alias("_s"))
    b = ids.select(F.col(old).alias("dst"), F.col(new).alias("_d"))
    return edges.join(a, "src").join(b, "dst").withColumn("src", F.col("_s")).withColumn("dst", F.col("_d")).select(*edges.columns)


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """src, dst of all pairs with a path of one edge or more, by doubling.

    Each round joins the pairs found with themselves, so n rounds reach paths of 2^n edges. Ends
    when a round adds nothing; raises beyond `most` rounds.
    """
    found = edges.select("src", "dst").distinct()
    size = found.count()
    for _ in range(most):
        step = found.select(F.col("src").alias("dst"), F.col("dst").alias("_far"))
        found = _cut(found.unionByName(found.join(step, "dst").select("src", F.col("_far").alias("dst"))).distinct())
        grown = found.count()
        if grown == size:
            return found
        size = grown
    raise ValueError("the closure did not settle")


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, in the folder spark.checkpoint.dir names."""
    _shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet beside the checkpoints and read again: for what several branches read."""
    path = f"{_shared_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(df: DataFrame) -> str:
    """The session's folder of checkpoints.

    Where it is unset, a session on this machine alone gets a folder of its own; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/tessera-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def levels(nodes: DataFrame, edges: DataFrame, node: str, most: int = 1000) -> DataFrame:
    """node, level: edges of the longest path that ends at each node of an acyclic graph.

    Rounds raise the level of a node above its predecessors' until none changes. Nodes on a cycle
    never settle: beyond `most` rounds it raises.
    """
    now = _cut(nodes.select(node, F.lit(0).alias("level")))
    for _ in range(most):
        pushed = edges.join(now.withColumnRenamed(node, "src"), "src").groupBy(F.col("dst").alias(node)).agg((F.max("level") + 1).alias("_next"))
        new = _cut(now.join(pushed, node, "left").select(node, F.greatest("level", F.coalesce("_next", F.lit(0))).alias("level"), "level").toDF(node, "level", "_was"))
        changed = new.where("level <> _was").limit(1).count()
        now = new.select(node, "level")
        if not changed:
            return now
    raise ValueError("levels did not settle; the graph has a cycle")


def khop(seeds: DataFrame, edges: DataFrame, group: str, node: str, hops: int = 1) -> DataFrame:
    """group, node: the seeds of each group and what they reach over at most `hops` edges, forwards."""
    found = frontier = seeds.select(group, node).distinct()
    for _ in range(hops):
        frontier = frontier.join(edges.select(F.col("src").alias(node), "dst"), node).select(group, F.col("dst").alias(node)).distinct()
        found = found.unionByName(frontier).distinct()
    return found


def induced(members: DataFrame, edges: DataFrame, group: str, node: str) -> DataFrame:
    """group, src, dst: edges with both ends in the group."""
    a = members.select(group, F.col(node).alias("src"))
    b = members.select(group, F.col(node).alias("dst"))
    return edges.select("src", "dst").join(a, "src").join(b, [group, "dst"]).select(group, "src", "dst")


def drop_tiny(members: DataFrame, edges: DataFrame, group: str, least_nodes: int = 2, least_edges: int = 1) -> DataFrame:
    """group, n_nodes, n_edges of the groups that are large enough."""
    n = members.groupBy(group).agg(F.count("*").alias("n_nodes"))
    m = edges.groupBy(group).agg(F.count("*").alias("n_edges"))
    return n.join(m, group, "left").select(group, "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges")).where((F.col("n_nodes") >= least_nodes) & (F.col("n_edges") >= least_edges))


def standardise(counts: DataFrame, graphs: DataFrame, relations: DataFrame, keys: list[str], graph: str) -> DataFrame:
    """Every required relation of every graph, with 0 edges where it has none.

    relations is a vocabulary, a row per relation; it is broadcast.
    """
    wanted = graphs.select(graph).distinct().crossJoin(F.broadcast(relations.select(*keys)))
    return wanted.join(counts, [graph, *keys], "left").fillna(0, [c for c in counts.columns if c not in (graph, *keys)])


def propagate_one_hop(flagged: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Flagged nodes and their neighbours over one edge either way: node, and how it got its flag."""
    own = flagged.select(node, F.lit(0).alias("_p"), F.lit("own").alias("via"))
    ahead = edges.join(flagged.select(F.col(node).alias("src")), "src", "left_semi").select(F.col("dst").alias(node), F.lit(1).alias("_p"), F.lit("forward").alias("via"))
    back = edges.join(flagged.select(F.col(node).alias("dst")), "dst", "left_semi").select(F.col("src").alias(node), F.lit(2).alias("_p"), F.lit("backward").alias("via"))
    return own.unionByName(ahead).unionByName(back).groupBy(node).agg(F.min_by("via", "_p").alias("via"))


def message_aggregate(edges: DataFrame, vectors: DataFrame, node: str, dims: list[str], how: str = "sum") -> DataFrame:
    """Per target node, the sum, mean or degree-normalised sum of its sources' vector columns."""
    x = vectors.select(F.col(node).alias("src"), *dims)
    joined = edges.join(x, "src")
    if how == "gcn":
        o = edges.groupBy("src").agg(F.count("*").alias("_o"))
        i = edges.groupBy("dst").agg(F.count("*").alias("_i"))
        joined = joined.join(o, "src").join(i, "dst")
        return joined.groupBy(F.col("dst").alias(node)).agg(*[F.sum(F.col(d) / F.sqrt(F.col("_o") * F.col("_i"))).alias(d) for d in dims])
    f = F.avg if how == "mean" else F.sum
    return joined.groupBy(F.col("dst").alias(node)).agg(*[f(d).alias(d) for d in dims])


def softmax_by(df: DataFrame, keys: list[str], score: Column, out: str) -> DataFrame:
    """exp(score) over its sum per key, less the key's largest score for safety."""
    w = W.partitionBy(*keys)
    e = F.exp(F.col("_s") - F.max("_s").over(w))
    return df.withColumn("_s", score).withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")
