"""Queries of the ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordered as O
from tessera.plans.catalogue import query
from tessera.sources import table

_IS = lambda t: F.col("event_type") == t


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS context_id FROM events""")
def context_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.carry_context(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(_IS("signup"), F.col("event_id")), "context_id", F.lit(-1))
    return out.select("event_id", "user_id", "context_id")


@query("""SELECT l_orderkey, min(l_linenumber) AS range_from, max(l_linenumber) AS range_to FROM (
  SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')) GROUP BY l_orderkey, run""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.islands(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), ["l_orderkey"], "l_linenumber")


@query("""SELECT l.event_id, l.user_id, r.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'error') l
  ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.ts > r.ts""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.asof_backward(table(spark, sf_dir, "events"), ["user_id"], "ts", _IS("error"), _IS("signup"), F.col("event_id"), "signup_id")
    return out.where("signup_id IS NOT NULL").select("event_id", "user_id", "signup_id")


@query("""SELECT l.event_id, coalesce(
    (SELECT min_by(r.event_id, r.ts) FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'signup' AND r.ts > l.ts),
    (SELECT max_by(r.event_id, r.ts) FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'signup' AND r.ts < l.ts)) AS signup_id
  FROM events l WHERE event_type = 'error'""")
def asof_forward_then_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.asof_forward_then_back(table(spark, sf_dir, "events"), ["user_id"], "ts", _IS("error"), _IS("signup"), F.col("event_id"), "signup_id")
    return out.select("event_id", "signup_id")


@query("""SELECT event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_error FROM events""")
def proximity_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.near_marker(table(spark, sf_dir, "events"), ["user_id"], "ts", _IS("error"), 5, "near_error").select("event_id", "near_error")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
  SELECT doc_id, 1 + doc_id % 3 AS line_from, 3 + doc_id % 5 AS line_to, string_agg(line, chr(10) ORDER BY line_no) AS snippet
  FROM l WHERE line_no BETWEEN 1 + doc_id % 3 AND 3 + doc_id % 5 GROUP BY doc_id""")
def interval_join_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")
    spans = docs.select("doc_id", (1 + F.col("doc_id") % 3).alias("line_from"), (3 + F.col("doc_id") % 5).alias("line_to"))
    return O.interval_text(lines, spans, "doc_id", "line_no", "line", "line_from", "line_to")


@query("""WITH s AS (SELECT user_id, ts, event_id, event_type, bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS opened FROM events),
  d AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS depth FROM s WHERE opened)
  SELECT user_id, min(ts) AS opened_at, min(CASE WHEN depth = 0 THEN ts END) AS closed_at FROM d GROUP BY user_id""")
def balanced_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.balanced_scan(table(spark, sf_dir, "events"), ["user_id"], "ts", _IS("signup"), _IS("error"))


@query("""SELECT c_custkey, c_nationkey, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS nation_id
  FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = O.dense_ids(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", "nation_id").select("n_nationkey", "nation_id")
    return table(spark, sf_dir, "customer").join(ranked, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "nation_id")


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY {', '.join(_LINE)}) AS n FROM lineitem) WHERE l_returnflag = 'R' OR n <= 2""")
def first_n_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.first_n(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE, F.col("l_returnflag") == "R", 2)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (
  SELECT (o_orderdate, o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 10 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def resume_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 10 == 0)
    return O.resume_after(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], done).select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 500 AS shard FROM orders""")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chunks(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 500, "shard").select("o_orderkey", "o_orderpriority", "shard")


@query("""SELECT user_id, event_type, min_by(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY user_id, event_type""")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS epoch, value AS score, 1000 - value + event_id % 7 AS loss FROM events WHERE event_type = 'view'),
  a AS (SELECT *, max(score) OVER w AS best_score, coalesce(score > max(score) OVER b, true) AS improved, coalesce(loss < min(loss) OVER b, true) AS less FROM e
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT *, epoch - max(CASE WHEN less THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM a)
  SELECT user_id, epoch, best_score, improved, waited, bool_or(waited >= 3) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM c""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where(_IS("view"))
    from pyspark.sql import Window as W

    runs = views.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts")).alias("epoch"), F.col("value").alias("score"), (1000 - F.col("value") + F.col("event_id") % 7).alias("loss"))
    return O.running_best(runs, ["user_id"], "epoch", "score", "loss", 3).select("user_id", "epoch", "best_score", "improved", "waited", "stopped")
