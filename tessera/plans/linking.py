"""Queries of the linking joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import linking as L
from tessera.plans.catalogue import query
from tessera.sources import table


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey // 4 AS target, l_suppkey % 8 AS args FROM lineitem),
  d AS (SELECT p_partkey, p_partkey // 4 AS target, p_size % 8 AS d_args FROM part),
  j AS (SELECT *, coalesce(args = d_args, false) AS exact FROM s JOIN d USING (target))
  SELECT l_orderkey, l_linenumber, target, args, p_partkey, exact FROM (SELECT *, bool_or(exact) OVER (PARTITION BY l_orderkey, l_linenumber, target, args) AS a FROM j) WHERE exact OR NOT a""")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey div 4").alias("target"), (F.col("l_suppkey") % 8).alias("args")).distinct()
    defs = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 4").alias("target"), (F.col("p_size") % 8).alias("d_args"))
    out = L.resolve_calls(sites, defs, ["l_orderkey", "l_linenumber", "target", "args"], ["target"], "args", "d_args")
    return out.select("l_orderkey", "l_linenumber", "target", "args", "p_partkey", "exact")


@query("""WITH c AS (SELECT DISTINCT o_orderkey AS site, o_custkey AS target FROM orders),
  r AS (SELECT DISTINCT o_custkey AS target, o_orderkey AS node FROM orders),
  f AS (SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders UNION SELECT o_orderkey, o_orderkey + 2 FROM orders WHERE o_orderstatus = 'F')
  SELECT DISTINCT r.node AS src, f.dst FROM c JOIN r USING (target) JOIN f ON f.src = c.site""")
def return_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    calls = orders.select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("target")).distinct()
    returns = orders.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("node")).distinct()
    flow = orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst")).unionByName(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 2).alias("dst")))
    return L.return_edges(calls, returns, flow.distinct(), "target", "site")


@query("""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
  SELECT DISTINCT d.user_id, d.k, d.event_id AS def, u.event_id AS use FROM e d JOIN e u ON d.user_id = u.user_id AND d.k = u.k AND d.ts < u.ts WHERE d.event_type = 'purchase' AND u.event_type = 'view'""")
def def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return L.def_use(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id", "k"], "ts", "event_id")


@query("""SELECT event_id, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS reaching FROM events""")
def reaching_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reaching_counts(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "reaching")


@query("""WITH u AS (
  SELECT c_custkey % 60 AS name, c_custkey AS owner, 0 AS priority FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT s_suppkey % 60, s_suppkey, 1 FROM supplier UNION ALL SELECT n_nationkey + 40, n_nationkey, 2 FROM nation)
  SELECT name, owner, priority FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority, owner) AS n FROM u) WHERE n = 1""")
def key_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 60).alias("name"), F.col("c_custkey").alias("owner"))
    inherited = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("name"), F.col("s_suppkey").alias("owner"))
    imported = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 40).cast("bigint").alias("name"), F.col("n_nationkey").cast("bigint").alias("owner"))
    return L.first_by_priority([own, inherited, imported], ["name"], ["owner"]).select("name", "owner", "priority")


_PREFIXES = "(VALUES ('a', 1), ('b', 2), ('bl', 3), ('s', 4), ('sm', 5), ('l', 6), ('g', 7), ('gr', 8)) AS x(prefix, code)"


@query(f"""SELECT p_partkey, p_name, max_by(code, length(prefix)) AS code FROM part JOIN {_PREFIXES} ON starts_with(p_name, prefix) GROUP BY p_partkey, p_name""")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.sql(f"SELECT * FROM {_PREFIXES.replace('(VALUES', 'VALUES', 1).replace(')) AS', ') AS', 1)}")
    out = L.prefix_join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), prefixes, "p_name", "prefix", (1, 2))
    return out.select("p_partkey", "p_name", "code")


@query("""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def snippet_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("snippet"))
    return L.contains_matches(docs, items, "text", "snippet").select("doc_id", "item_id")


@query("""SELECT 'orders without customer' AS what, count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
  UNION ALL SELECT 'customers without order', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
  UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def set_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    count = lambda d, what: d.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(L.missing_keys(a, b, ["k"]), "orders without customer").unionByName(count(L.missing_keys(b, a, ["k"]), "customers without order")).unionByName(count(a.intersect(b), "both"))


@query("""SELECT p_name, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n_brands")).where("n_brands > 1")


@query("""SELECT c_custkey, c_name, count(*) AS tx_count FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY tx_count DESC, c_custkey""")
def tx_count_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are counted by customer before the join, so the join carries one row a customer."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("tx_count"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(counts, "c_custkey").orderBy(F.desc("tx_count"), "c_custkey")


@query("""WITH u AS (
  SELECT 'events' AS tool, user_id AS owner, event_id AS line, event_type AS category FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'labels', doc_id % 150, doc_id, 'toxic' FROM labels WHERE toxic = 1
  UNION ALL SELECT 'lines', l_orderkey % 150, l_partkey, 'R' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'))
  SELECT owner, tool, line, category, row_number() OVER (PARTITION BY owner ORDER BY tool, line, category) AS counter FROM (SELECT DISTINCT * FROM u)""")
def multi_branch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    a = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("events").alias("tool"), F.col("user_id").alias("owner"), F.col("event_id").alias("line"), F.col("event_type").alias("category"))
    b = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("labels").alias("tool"), (F.col("doc_id") % 150).alias("owner"), F.col("doc_id").alias("line"), F.lit("toxic").alias("category"))
    c = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lit("lines").alias("tool"), (F.col("l_orderkey") % 150).alias("owner"), F.col("l_partkey").alias("line"), F.lit("R").alias("category"))
    rows = a.unionByName(b).unionByName(c).distinct()
    return rows.select("owner", "tool", "line", "category", F.row_number().over(W.partitionBy("owner").orderBy("tool", "line", "category")).alias("counter"))
