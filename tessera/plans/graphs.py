"""Queries of the graph operators. The TPC-H keys are a typed graph: lines, orders, customers, nations, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import graphs as G
from tessera.plans.catalogue import query
from tessera.sources import table


def _int_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The halving tree of the doc_ids: n -> n div 2."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    edges = nodes.where("node > 0").select(F.col("node").alias("src"), F.floor(F.col("node") / 2).alias("dst"))
    return nodes, edges


_TYPED = """typed AS (
  SELECT 'order' AS src_type, o_orderkey AS src, 'placed_by' AS etype, 'customer' AS dst_type, o_custkey AS dst FROM orders
  UNION ALL SELECT 'customer', c_custkey, 'lives_in', 'nation', c_nationkey FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, 'lives_in', 'nation', s_nationkey FROM supplier
  UNION ALL SELECT 'nation', n_nationkey, 'part_of', 'region', n_regionkey FROM nation
  UNION ALL SELECT 'nation', n_nationkey, 'next_to', 'nation', n_nationkey + 1 FROM nation WHERE n_nationkey < 24)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def e(name: str, st: str, s: str, et: str, dt: str, d: str, where: str = "true") -> DataFrame:
        return table(spark, sf_dir, name).where(where).select(F.lit(st).alias("src_type"), F.expr(f"CAST({s} AS bigint)").alias("src"), F.lit(et).alias("etype"), F.lit(dt).alias("dst_type"), F.expr(f"CAST({d} AS bigint)").alias("dst"))

    return (
        e("orders", "order", "o_orderkey", "placed_by", "customer", "o_custkey")
        .unionByName(e("customer", "customer", "c_custkey", "lives_in", "nation", "c_nationkey"))
        .unionByName(e("supplier", "supplier", "s_suppkey", "lives_in", "nation", "s_nationkey"))
        .unionByName(e("nation", "nation", "n_nationkey", "part_of", "region", "n_regionkey"))
        .unionByName(e("nation", "nation", "n_nationkey", "next_to", "nation", "n_nationkey + 1", "n_nationkey < 24"))
    )


@query("""SELECT src, dst, max_by(status, (o_orderdate, o_orderkey)) AS status, max_by(big, (o_orderdate, o_orderkey)) FILTER (WHERE big IS NOT NULL) AS big FROM (
  SELECT o_custkey % 100 AS src, o_custkey % 7 AS dst, o_orderdate, o_orderkey, o_orderstatus AS status, CASE WHEN o_totalprice > 200000 THEN o_orderkey END AS big FROM orders) GROUP BY src, dst""")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("src"), (F.col("o_custkey") % 7).alias("dst"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey")).alias("big")
    )
    return G.upsert_edges(edges, ["src", "dst"], ["o_orderdate", "o_orderkey"], ["status", "big"])


@query("""SELECT o_orderkey AS node FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def degrees_entry_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order leads to its customer's next one; the first ones are entered by none."""
    orders = table(spark, sf_dir, "orders")
    following = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(F.col("o_orderkey").alias("src"), following.alias("dst")).where("dst IS NOT NULL")
    return G.entry_nodes(orders.select(F.col("o_orderkey").alias("node")), edges, "node")


@query("""SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (
  SELECT doc_id AS node, 0 AS i, 1 AS o FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id // 2, 1, 0 FROM documents WHERE doc_id > 0) GROUP BY node""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_int_graph(spark, sf_dir)[1], "node")


@query("""WITH ids AS (SELECT c_custkey AS old, row_number() OVER (ORDER BY c_custkey) - 1 AS new FROM customer WHERE c_acctbal > 0),
  e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer)
  SELECT a.new AS src, b.new AS dst FROM e JOIN ids a ON a.old = e.src JOIN ids b ON b.old = e.dst""")
def id_remap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    ids = G.contiguous_ids(customer.where("c_acctbal > 0").select("c_custkey"), ["c_custkey"], "new")
    edges = customer.select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 2).alias("dst"))
    return G.remap_edges(edges, ids, "c_custkey", "new")


@query("""WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0),
  r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(_int_graph(spark, sf_dir)[1])


@query("""WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0),
  r(node, level) AS (SELECT doc_id, 0 FROM documents UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(level) AS level FROM r GROUP BY node""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _int_graph(spark, sf_dir)
    return G.levels(nodes, edges, "node")


_KHOP = """WITH e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer),
  seeds AS (SELECT c_nationkey AS g, c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'),
  m AS (SELECT g, node FROM seeds UNION SELECT g, dst FROM seeds JOIN e ON src = node),
  i AS (SELECT a.g, e.src, e.dst FROM e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst AND a.g = b.g)
"""


@query(_KHOP + """SELECT g AS graph, n_nodes, n_edges FROM (SELECT g, count(*) AS n_nodes FROM m GROUP BY g) JOIN (SELECT g, count(*) AS n_edges FROM i GROUP BY g) USING (g)
  WHERE n_nodes >= 2 AND n_edges >= 1""")
def khop_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    edges = customer.select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 2).alias("dst"))
    seeds = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("graph"), F.col("c_custkey").alias("node"))
    members = G.khop(seeds, edges, "graph", "node", 1)
    return G.drop_tiny(members, G.induced(members, edges, "graph", "node"), "graph")


@query(f"""WITH {_TYPED}, g AS (SELECT DISTINCT src % 100 AS graph FROM typed), r AS (SELECT DISTINCT src_type, etype, dst_type FROM typed),
  n AS (SELECT src % 100 AS graph, src_type, etype, dst_type, count(*) AS n_edges FROM typed GROUP BY ALL)
  SELECT g.graph, r.*, coalesce(n.n_edges, 0) AS n_edges FROM g CROSS JOIN r LEFT JOIN n USING (graph, src_type, etype, dst_type)""")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir).withColumn("graph", F.col("src") % 100)
    keys = ["src_type", "etype", "dst_type"]
    counts = typed.groupBy("graph", *keys).agg(F.count("*").alias("n_edges"))
    return G.standardise(counts, typed, typed.select(*keys).distinct(), keys, "graph")


@query(f"""WITH {_TYPED} SELECT src_type, etype, dst_type, count(*) FILTER (WHERE src_type <> 'supplier' AND dst_type <> 'supplier') AS n_edges FROM typed GROUP BY ALL""")
def ablate_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = (F.col("src_type") == "supplier") | (F.col("dst_type") == "supplier")
    return _typed(spark, sf_dir).groupBy("src_type", "etype", "dst_type").agg(F.count_if(~gone).alias("n_edges"))


@query(f"""WITH {_TYPED} SELECT src, etype, dst FROM typed WHERE src_type = dst_type AND etype IN ('next_to', 'part_of')""")
def drop_cross_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).where("src_type = dst_type AND etype IN ('next_to', 'part_of')").select("src", "etype", "dst")


@query("""WITH e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0), f AS (SELECT DISTINCT doc_id AS node FROM labels WHERE toxic = 1)
  SELECT node, CASE min(p) WHEN 0 THEN 'own' WHEN 1 THEN 'forward' ELSE 'backward' END AS via FROM (
    SELECT node, 0 AS p FROM f UNION ALL SELECT dst, 1 FROM e WHERE src IN (SELECT node FROM f) UNION ALL SELECT src, 2 FROM e WHERE dst IN (SELECT node FROM f)) GROUP BY node""")
def propagate_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("node")).distinct()
    return G.propagate_one_hop(found, _int_graph(spark, sf_dir)[1], "node")


#: all columns of an embedding
_DIMS = [f"d{i}" for i in range(64)]
_VECTORS = "v AS (SELECT vec_id AS node, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(64)) + " FROM embeddings), e AS (SELECT vec_id AS src, vec_id // 3 AS dst FROM embeddings)"


def _message(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    vectors = emb.select(F.col("vec_id").alias("node"), *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(_DIMS)])
    edges = emb.select(F.col("vec_id").alias("src"), F.floor(F.col("vec_id") / 3).alias("dst"))
    out = G.message_aggregate(edges, vectors, "node", _DIMS, how)
    return out.select("node", *[F.round(d, 6).alias(d) for d in _DIMS])


def _message_sql(f: str) -> str:
    return f"WITH {_VECTORS} SELECT dst AS node, " + ", ".join(f"round({f}({d}), 6) AS {d}" for d in _DIMS) + " FROM e JOIN v ON v.node = e.src GROUP BY dst"


@query(_message_sql("sum"))
def message_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(spark, sf_dir, "sum")


@query(_message_sql("avg"))
def message_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(spark, sf_dir, "mean")


@query(f"WITH {_VECTORS}, o AS (SELECT src, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT e.dst AS node, " + ", ".join(f"round(sum({d} / sqrt(o.n * i.n)), 6) AS {d}" for d in _DIMS) + " FROM e JOIN v ON v.node = e.src JOIN o ON o.src = e.src JOIN i ON i.dst = e.dst GROUP BY e.dst")
def gcn_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(spark, sf_dir, "gcn")


@query(f"""WITH {_TYPED}, n AS (SELECT dst_type, dst, etype, count(*) AS n FROM typed GROUP BY ALL)
  SELECT dst_type, dst, etype, round(exp(n / 10.0 - max(n / 10.0) OVER w) / sum(exp(n / 10.0 - m)) OVER w, 6) AS weight
  FROM (SELECT *, max(n / 10.0) OVER (PARTITION BY dst_type, dst) AS m FROM n) WINDOW w AS (PARTITION BY dst_type, dst)""")
def relation_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _typed(spark, sf_dir).groupBy("dst_type", "dst", "etype").agg(F.count("*").alias("n"))
    return G.softmax_by(n, ["dst_type", "dst"], F.col("n") / 10.0, "w").select("dst_type", "dst", "etype", F.round("w", 6).alias("weight"))


@query("SELECT label, " + ", ".join(f"round(sum(embedding[{i + 1}]::DOUBLE), 6) AS d{i}" for i in range(64)) + " FROM embeddings GROUP BY label")
def readout_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(*[F.round(F.sum(F.col("embedding")[i].cast("double")), 6).alias(d) for i, d in enumerate(_DIMS)])
