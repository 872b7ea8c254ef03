"""Queries of rule scans, line matches, parses of short texts, and the step ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vocabulary import NO_CATEGORY, RULE_CATEGORIES, RULES
from tessera.operators import rules as R
from tessera.plans.catalogue import query
from tessera.sources import table

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


_CODE = """CASE event_type WHEN 'view' THEN 'a.transfer(' || user_id || ');' WHEN 'click' THEN 'uint x' || user_id || ' ;' WHEN 'purchase' THEN 'x.call{value:1}(y)' WHEN 'error' THEN 'require(tx.origin==block.timestamp)'
  ELSE CASE WHEN event_id % 3 = 0 THEN 'delegatecall(a+SafeMath' WHEN event_id % 3 = 1 THEN 'a ++SafeMath' ELSE 'b / SafeMath, block.gaslimit' END END"""
#: the rules in a dialect without lookahead: an operator that SafeMath follows at once is none
_SQL_RULES = [(r, "[-+*/]" if r == "SWC-101" else p) for r, p, _, _ in RULES]


@query(f"WITH {_LINES}, a AS (SELECT doc_id AS id, line_no, line FROM l UNION ALL SELECT -1 - event_id, 1, {_CODE} FROM events), r(rule_id, p, severity, category) AS (VALUES "
       + ", ".join(f"('{i}', '{p}', '{s}', '{RULE_CATEGORIES[i]}')" for (i, p), (_, _, s, _) in zip(_SQL_RULES, RULES, strict=True))
       + ") SELECT id, line_no, rule_id, severity, category FROM a JOIN r ON regexp_matches(CASE WHEN rule_id = 'SWC-101' THEN regexp_replace(line, '[-+*/]SafeMath', '', 'g') ELSE line END, p)")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rules over the lines of all documents, and over a line of code made of every event."""
    code = table(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("id"), F.lit(1).alias("line_no"), F.expr(_CODE).alias("line"))
    docs = R.lines(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumnRenamed("doc_id", "id")
    severity = F.create_map(*[F.lit(x) for r, _, s, _ in RULES for x in (r, s)])
    found = R.scan(docs.unionByName(code), [(r, p) for r, p, _, _ in RULES])
    return found.select("id", "line_no", "rule_id", severity[F.col("rule_id")].alias("severity"), R.category(F.col("rule_id"), RULE_CATEGORIES, NO_CATEGORY).alias("category"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' NodeTypes.AST_NODE ' WHEN '2-HIGH' THEN 'cfg' WHEN '3-MEDIUM' THEN 'LastCfg' WHEN '4-NOT SPECIFIED' THEN 'my cfg node' ELSE NULL END AS raw FROM orders)
  SELECT o_orderkey, raw, CASE WHEN contains(lower(raw), 'ast') THEN 'ast_node' ELSE 'cfg_node' END AS node_type FROM r""")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN ' NodeTypes.AST_NODE ' WHEN '2-HIGH' THEN 'cfg' WHEN '3-MEDIUM' THEN 'LastCfg' WHEN '4-NOT SPECIFIED' THEN 'my cfg node' ELSE NULL END")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", R.node_type(F.col("raw")).alias("node_type"))


_PATHS = """CASE WHEN o_orderkey % 4 = 0 THEN '/data/base/' || o_custkey || '/a.sol' WHEN o_orderkey % 4 = 1 THEN translate('/data/base/' || o_custkey || '.sol', '/', chr(92)) WHEN o_orderkey % 4 = 2 THEN '/x/temp_projects/' || o_custkey || '/b.sol' ELSE '/data/baseline/' || o_custkey || '/c.sol' END"""


@query(f"WITH p AS (SELECT o_orderkey, {_PATHS} AS path FROM orders)" + """ SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN substr(replace(path, chr(92), '/'), 12) WHEN o_orderkey % 4 = 2 THEN path ELSE 'c.sol' END AS path FROM p""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PATHS).alias("path")).select("o_orderkey", R.relative_path(F.col("path"), F.lit("/data/base/")).alias("path"))


@query("""SELECT c_custkey, json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_nationkey', c_nationkey)::VARCHAR AS attributes FROM customer""")
def attributes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", R.attributes_json("c_custkey", "c_name", "c_nationkey").alias("attributes"))


@query("""SELECT key, min(part)::INT AS part, arg_min(place, part)::BIGINT AS place FROM (
  SELECT o_custkey AS key, 0 AS part, min(o_orderkey) AS place FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 1, c_custkey FROM customer) GROUP BY key""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("place"))
    return R.ordered_union([first, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("place"))], "key")


@query("""SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 1""")
def one_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.one_project(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 42)


@query(f"""WITH {_LINES}, b AS (SELECT md5(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\r\\n\\x0B\\f]+', '', 'g')) AS m, item_id FROM benchmark), f AS (SELECT m, min(item_id) AS item_id FROM b GROUP BY m)
  SELECT doc_id, line_no, item_id FROM l JOIN f ON m = md5(regexp_replace(line, '[ \\t\\r\\n\\x0B\\f]+', '', 'g')) WHERE line <> ''""")
def line_md5_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(R.squeeze(F.col("line")))
    docs = R.lines(table(spark, sf_dir, "documents"), ["doc_id"], "text").where("line <> ''").withColumn("m", digest)
    items = R.lines(table(spark, sf_dir, "benchmark"), ["item_id"], "text").withColumn("m", digest)
    return R.first_match(docs, items, "m", ["doc_id", "line_no"], "item_id").select("doc_id", "line_no", "item_id")


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS name, split_part(p_name, ' ', 2) AS args, split_part(p_brand, '#', 1) AS kind, split_part(p_brand, '#', 2)::INT AS number FROM part""")
def signature_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, args = R.signature(F.concat(F.split("p_name", " ")[0], F.lit("("), F.split("p_name", " ")[1], F.lit(" x)")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), args.alias("args"), F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("kind"), F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("number"))


@query("""SELECT event_id, 'L' || (user_id * 1000) AS r, (user_id * 1000)::VARCHAR AS line_from,
  CASE WHEN length((event_id * 100)::VARCHAR) > 7 THEN 'invalid' ELSE (event_id * 100)::VARCHAR END AS line_to FROM events""")
def line_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of two parts; beyond what the reader checks, an end of more than seven characters is `invalid` here."""
    number = lambda c, k: F.coalesce((F.col(c) * k).cast("string"), F.lit(""))
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("L"), F.col("user_id") * 1000).alias("r"), F.concat(F.lit(" L"), number("user_id", 1000), F.lit("-l"), number("event_id", 100)).alias("t"))
    a, b = (F.nullif(x, F.lit("")) for x in R.line_range(F.col("t")))
    return e.select("event_id", "r", a.alias("line_from"), F.when(F.length(b) > 7, "invalid").otherwise(b).alias("line_to"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS n_act, count(*) FILTER (WHERE event_type = 'error') AS n_error,
  count(*) FILTER (WHERE value > 50) AS n_large, sum(length(props))::BIGINT AS n_chars FROM events GROUP BY user_id""")
def ir_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(t == "view").alias("n_view"), F.count_if(t.isin("purchase", "click")).alias("n_act"), F.count_if(t == "error").alias("n_error"), F.count_if(F.col("value") > 50).alias("n_large"), F.sum(F.length("props")).alias("n_chars")
    )


_BUCKETS = [("license", "icense"), ("shout", "[A-Z][A-Z][A-Z]"), ("junk", r"\*\*\*|%%%|###"), ("table", r" \| "), ("long", "^.{200}")]


@query(f"WITH {_LINES}, c AS (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{b}'" for b, p in _BUCKETS) + " ELSE 'other' END AS b FROM l) SELECT doc_id, "
       + ", ".join(f"count(*) FILTER (WHERE b = '{b}') AS {b}" for b in [*[b for b, _ in _BUCKETS], "other"]) + " FROM c GROUP BY doc_id")
def opcode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(R.lines(table(spark, sf_dir, "documents"), ["doc_id"], "text"), ["doc_id"], "line", _BUCKETS, "other")


@query("""SELECT p_type, max(low) AS version FROM (SELECT p_type, p_size, min(split_part(p_brand, '#', 2)::INT) AS low FROM part GROUP BY 1, 2) GROUP BY p_type""")
def version_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lowest_then_highest(table(spark, sf_dir, "part"), "p_size", "p_type", R.version_parts(F.col("p_brand"))).select("p_type", F.col("version")[0].alias("version"))


@query("""SELECT doc_id, regexp_matches(text, '[0-9][0-9][0-9]-[0-9]') AS has_number, coalesce(try_cast(regexp_extract(text, '[0-9]+') AS BIGINT), 0) AS tx_count FROM documents ORDER BY tx_count DESC""")
def address_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[0-9][0-9][0-9]-[0-9]").alias("has_number"), R.coerce_long(F.regexp_extract("text", "[0-9]+", 0)).alias("tx_count")).orderBy(F.desc("tx_count"))


@query("""WITH g AS (SELECT o_custkey % 300 AS project, CASE o_orderpriority WHEN '1-URGENT' THEN 'ast' WHEN '2-HIGH' THEN 'cfg' ELSE 'ir' END AS step, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS status, o_orderdate, o_orderkey FROM orders),
  last AS (SELECT project, step, max_by(status, (o_orderdate, o_orderkey)) AS status FROM g GROUP BY 1, 2), w AS (SELECT DISTINCT project, unnest(['ast', 'cfg', 'ir']) AS step FROM g)
  SELECT w.project, w.step FROM w LEFT JOIN last USING (project, step) WHERE coalesce(status, 0) <> 1""")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ledger = orders.select((F.col("o_custkey") % 300).alias("project"), F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'ast' WHEN '2-HIGH' THEN 'cfg' ELSE 'ir' END").alias("step"), F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 0 END").alias("status"), "o_orderdate", "o_orderkey")
    latest = R.ledger_latest(ledger, ["project", "step"], ["o_orderdate", "o_orderkey"])
    return R.pending(ledger, ["ast", "cfg", "ir"], latest, "project", True)
