"""Queries of the label and sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.plans.catalogue import query
from tessera.sources import table

_TAXONOMY = [("error", "SC01"), ("purchase", "SC03"), ("view", "SC05"), ("click", "X")]
_TAX_SQL = "(VALUES ('error', 'SC01'), ('purchase', 'SC03'), ('view', 'SC05'), ('click', 'X')) t(event_type, category)"


def _taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TAXONOMY, "event_type string, category string").where("category <> 'X'")


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
  SELECT p_brand, n, round(100.0 * n / (SELECT sum(n) FROM c), 2) AS percent FROM c ORDER BY n DESC, p_brand LIMIT 20""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return L.distribution(lines, "p_brand", 20)


@query("""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), b AS (SELECT * FROM c ORDER BY n DESC, p_type LIMIT 3)
  SELECT * FROM b UNION ALL SELECT 'Others', coalesce(sum(n), 0)::BIGINT FROM c WHERE p_type NOT IN (SELECT p_type FROM b)""")
def top_with_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_with_others(table(spark, sf_dir, "part"), "p_type", 3)


@query(f"SELECT event_id, e.event_type, category FROM events e JOIN {_TAX_SQL} ON t.event_type = e.event_type WHERE category <> 'X'")
def taxonomy_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.map_taxonomy(table(spark, sf_dir, "events").select("event_id", "event_type"), _taxonomy(spark), "event_type", "category", True).select("event_id", "event_type", "category")


@query(f"SELECT event_id, e.event_type, coalesce(category, 'N/A') AS category FROM events e LEFT JOIN (SELECT * FROM {_TAX_SQL} WHERE category <> 'X') t ON t.event_type = e.event_type")
def taxonomy_map_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.map_taxonomy(table(spark, sf_dir, "events").select("event_id", "event_type"), _taxonomy(spark), "event_type", "category", False).select("event_id", "event_type", "category")


@query("""WITH o AS (SELECT l_orderkey, max((l_returnflag = 'R' AND l_quantity >= 50)::INT) AS label FROM lineitem GROUP BY 1),
  c AS (SELECT o_custkey, max(label) AS label, count(*) FILTER (WHERE label = 1) AS hits, count(*) AS n_orders FROM o JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT c_nationkey, o_custkey AS c_custkey, label, max(label) OVER (PARTITION BY c_nationkey) AS nation_label FROM c JOIN customer ON c_custkey = o_custkey""")
def bubble_up_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines bubble up to orders before the join, orders to customers before the next one."""
    flag = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50)
    orders = L.bubble_up(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), flag, ["l_orderkey"])["l_orderkey"]
    placed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = L.bubble_up(orders.join(placed, "l_orderkey"), F.col("label") == 1, ["c_custkey"])["c_custkey"]
    homes = customers.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    nations = L.bubble_up(homes.select("c_nationkey", "label"), F.col("label") == 1, ["c_nationkey"])["c_nationkey"].withColumnRenamed("label", "nation_label")
    return homes.join(nations, "c_nationkey").select("c_nationkey", "c_custkey", "label", "nation_label")


_TYPES = ["ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE", "NONE", "OTHER"]


@query("SELECT l_suppkey, " + ", ".join(f"max((p_type = '{c}')::INT)::DOUBLE AS c{i}" for i, c in enumerate(_TYPES)) + " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
    return L.multi_hot(lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey"), ["l_suppkey"], "p_type", _TYPES)


_SEGMENTS = ["building", "machinery", "furniture"]


@query("SELECT c_custkey, " + ", ".join(f"(lower(c_mktsegment) = '{s}')::INT::DOUBLE AS is_{s}" for s in _SEGMENTS) + " FROM customer")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(f"is_{s}") for c, s in zip(L.one_hot(F.col("c_mktsegment"), _SEGMENTS), _SEGMENTS, strict=True)])


@query("""WITH s AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS g, bool_or(o_orderstatus = 'O') AS t, count(*) FILTER (WHERE o_totalprice > 300000) AS m FROM orders GROUP BY 1)
  SELECT c_custkey, CASE WHEN g IS NULL OR NOT g OR NOT t THEN 'failed' WHEN m > 0 THEN 'success' ELSE 'benign' END AS category FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def classify_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("g"), F.bool_or(F.col("o_orderstatus") == "O").alias("t"), F.count_if(F.col("o_totalprice") > 300000).alias("m"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(stats, "c_custkey", "left").select("c_custkey", L.outcome(F.col("g"), F.col("t"), F.col("m")).alias("category"))


@query("""SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.5 THEN 'success' ELSE 'holdout' END AS route FROM orders""")
def holdout_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(L.hash_share(F.col("o_orderkey"), 42) < 0.5, "success").otherwise("holdout").alias("route"))


_SPLIT = """WITH r AS (SELECT doc_id, toxic, count(*) OVER (PARTITION BY toxic) AS n, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS r FROM labels),
  v AS (SELECT *, greatest(floor(n * 0.1), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS nv FROM r),
  t AS (SELECT *, greatest(n - floor(n * 0.8) - nv, CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS nt FROM v),
  split AS (SELECT doc_id, toxic, CASE WHEN r <= n - nv - nt THEN 'train' WHEN r <= n - nt THEN 'validation' ELSE 'test' END AS split FROM t)
"""


@query(_SPLIT + "SELECT doc_id, toxic, split FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 42)


@query(_SPLIT + "SELECT split, sum(toxic)::BIGINT AS pos, count(*) - sum(toxic)::BIGINT AS neg FROM split GROUP BY split")
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = L.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 42)
    return split.groupBy("split").agg(F.sum("toxic").alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))


@query("""SELECT doc_id, toxic, unnest(range(CASE WHEN toxic = 1 THEN 4 ELSE 1 END)) AS copy FROM labels""")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.oversample(table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.col("toxic") == 1, 4.0)


@query("""SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic = 0 ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY toxic = 0) AS n FROM labels)
  WHERE toxic <> 0 OR r <= floor(n * 0.4)""")
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.undersample(table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.col("toxic") == 0, 0.4, ["doc_id"], 42)


@query("""WITH c AS (SELECT 'quality' AS class, sum(quality)::BIGINT AS pos, count(*) - sum(quality)::BIGINT AS neg FROM labels UNION ALL SELECT 'toxic', sum(toxic)::BIGINT, count(*) - sum(toxic)::BIGINT FROM labels)
  SELECT class, pos, neg, round(least(greatest(neg / greatest(pos, 1)::DOUBLE, 1.0), 10.0), 6) AS weight FROM c""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_weights(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("""WITH c AS (SELECT p_type AS class, count(*) AS n FROM part GROUP BY 1), rare AS (SELECT class FROM c WHERE n < (SELECT avg(n) FROM c))
  SELECT l_orderkey, l_partkey, unnest(range(CASE WHEN class IS NULL THEN 1 ELSE 3 END)) AS copy FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  JOIN part ON p_partkey = l_partkey LEFT JOIN rare ON class = p_type""")
def rare_class_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    counts = part.groupBy("p_type").agg(F.count("*").alias("n"))
    rare = counts.crossJoin(F.broadcast(counts.agg(F.avg("n").alias("mean")))).where("n < mean").select("p_type", F.lit(True).alias("rare"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    tagged = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(rare, "p_type", "left")
    return L.oversample(tagged, F.coalesce("rare", F.lit(False)), 3.0).select("l_orderkey", "l_partkey", "copy")


@query("""SELECT 'binary_toxic' AS check, count(*) FILTER (WHERE toxic NOT IN (0, 1)) AS violations FROM labels
  UNION ALL SELECT 'has_quality', count(*) FILTER (WHERE quality IS NULL) FROM labels UNION ALL SELECT 'small_id', count(*) FILTER (WHERE NOT doc_id < 500) FROM labels""")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contract_violations(table(spark, sf_dir, "labels"), {"binary_toxic": F.col("toxic").isin(0, 1), "has_quality": F.col("quality").isNotNull(), "small_id": F.col("doc_id") < 500})
