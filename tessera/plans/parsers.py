"""Queries of the parsers: texts are made from tables in a known form, parsed, and checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.code_text import flattened, normalized
from tessera.functions.features import hashed_text, multi_hot_array
from tessera.functions.graph_text import DotRows, TreeRows, cfg_edge_type, cfg_features, cfg_label
from tessera.functions.ir import ir_counters, parse_ir
from tessera.plans.catalogue import query
from tessera.sources import table


@query("""SELECT n_regionkey AS graph, 'edge' AS kind, 'n' || n_nationkey AS name, 'r' || n_regionkey AS dst, n_name AS label FROM nation
  UNION ALL SELECT n_regionkey, 'node', 'n' || n_nationkey, NULL, 'Node "' || n_name || '"' FROM nation""")
def dot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("dot_rows", DotRows)
    n, r = F.format_string("n%d", "n_nationkey"), F.format_string("r%d", "n_regionkey")
    part = F.concat(F.lit("  "), n, F.lit(' [shape=box, label="Node \\"'), "n_name", F.lit('\\""];\n  '), n, F.lit(" -> "), r, F.lit(' [label="'), "n_name", F.lit('"];\n'))
    table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("graph")).agg(F.concat(F.lit('digraph "G" {\n  rankdir=LR; node [shape=box];\n  subgraph cluster_0 {\n'), F.array_join(F.collect_list(part), ""), F.lit("} }\n")).alias("text")).createOrReplaceTempView("_dots")
    return spark.sql("SELECT g.graph, d.* FROM _dots g, LATERAL dot_rows(g.text) d")


@query("""SELECT r_regionkey AS unit, 'SourceUnit' AS node_type, 'File: ' || r_name || '.sol' AS label, NULL AS contract, 0 AS depth FROM region
  UNION ALL SELECT n_regionkey, 'ContractDefinition', 'Contract: ' || n_name, n_name, 1 FROM nation
  UNION ALL SELECT n_regionkey, 'FunctionDefinition', 'f' || n_nationkey || '(uint x)', n_name, 2 FROM nation
  UNION ALL SELECT n_regionkey, 'Return', 'Return (x + ' || n_nationkey || ')', n_name, 4 FROM nation
  UNION ALL SELECT n_regionkey, 'Block', 'Block', n_name, 3 FROM nation""")
def syntax_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("tree_rows", TreeRows)
    text = F.format_string(
        '{"nodeType":"ContractDefinition","name":"%s","nodes":[{"nodeType":"PragmaDirective"},{"nodeType":"FunctionDefinition","name":"f%d","parameters":{"parameters":[{"nodeType":"VariableDeclaration","name":"x","typeName":{"nodeType":"ElementaryTypeName","name":"uint"}}]},'
        '"body":{"nodeType":"Block","statements":[{"nodeType":"Return","expression":{"nodeType":"BinaryOperation","operator":"+","leftExpression":{"nodeType":"Identifier","name":"x"},"rightExpression":{"nodeType":"Literal","value":"%d"}}}]}}]}',
        "n_name", "n_nationkey", "n_nationkey",
    )
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(text), ",").alias("inner"))
    units = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    units.select(F.col("r_regionkey").alias("unit"), F.concat(F.lit('{"nodeType":"SourceUnit","absolutePath":"a/b/'), "r_name", F.lit('.sol","nodes":['), "inner", F.lit("]}")).alias("text")).createOrReplaceTempView("_units")
    return spark.sql("SELECT u.unit, t.node_type, t.label, t.contract, t.depth FROM _units u, LATERAL tree_rows(u.text) t")


@query("""SELECT event_id, 4 AS ir_line_count, 4 AS ir_instruction_count, 5 AS ir_unique_var_count, 1 AS ir_call_count, 2 AS ir_assign_count, 1 AS ir_return_count, 3 AS ir_def_count, 5 AS ir_use_count, 'balance' AS last_use FROM events WHERE event_type = 'view'""")
def ir_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five names: TMP_k, amount, balance, TMP_k+1 and the call's argument; the type uint256 is none."""
    k = F.col("event_id").cast("string")
    line = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    text = F.concat_ws(
        "\n", line("TMP_", k, "(uint256) = amount + balance"), line("balance(uint256) := TMP_", k, "(uint256)"), line("TMP_x", k, "(bool) = SOLIDITY_CALL require(bool)(cond)"), line("RETURN balance")
    )
    e = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("ir", text).withColumn("instrs", parse_ir("ir"))
    c = ir_counters(F.col("instrs"), F.col("ir"))
    names = ["ir_line_count", "ir_instruction_count", "ir_unique_var_count", "ir_call_count", "ir_assign_count", "ir_return_count", "ir_def_count", "ir_use_count"]
    return e.select("event_id", *[c[n].alias(n) for n in names], F.element_at(F.element_at("instrs", -1)["uses"], 1).alias("last_use"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'if' WHEN event_type = 'click' THEN 'new variable' ELSE 'expression' END AS sub_node_type, event_id::INT AS node_no, 'require(a > ' || user_id || ')' AS expression, true AS has_require, 3 AS n_tokens,
  CASE WHEN event_type = 'view' THEN 'cf_true' WHEN event_type = 'error' THEN 'cf_false' WHEN event_type = 'purchase' THEN 'call' ELSE 'cf' END AS edge FROM events""")
def cfg_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "view", "IF").when(t == "click", "NEW VARIABLE").otherwise("EXPRESSION")
    text = F.concat(F.lit("Node Type: "), kind, F.lit(" "), F.col("event_id").cast("string"), F.lit("\n\nEXPRESSION:\nrequire(a > "), F.col("user_id").cast("string"), F.lit(")\n\nIRs:\n"), F.when(t == "purchase", "TMP_1 = HIGH_LEVEL_CALL, dest:x").otherwise("TMP_1 = a"))
    e = table(spark, sf_dir, "events").withColumn("text", text)
    p = cfg_label(F.col("text"))
    e = e.select("event_id", "event_type", *[c.alias(n) for n, c in p.items()])
    f = cfg_features(F.col("expression"), F.col("sub_node_type"))
    edge = cfg_edge_type(F.col("sub_node_type"), F.col("ir"), F.col("expression"), F.when(t == "error", " False "))
    return e.select("event_id", "sub_node_type", "node_no", "expression", f["expression_has_require"].alias("has_require"), f["expression_token_len"].alias("n_tokens"), edge.alias("edge"))


@query("""SELECT p_partkey, 'require(a' || p_size || '>b)' AS code FROM part""")
def code_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("require(bool,string)(a"), F.col("p_size").cast("string"), F.lit(" >  b)"))
    return table(spark, sf_dir, "part").select("p_partkey", normalized(text).alias("code"))


@query("""SELECT n_nationkey, 'pragma solidity ^0.8.0;' || chr(10) || chr(10) || 'library L' || n_nationkey || ' {}' || chr(10) || chr(10) || 'contract ' || n_name || ' {}' || chr(10) AS code FROM nation WHERE n_name NOT LIKE '% %'""")
def source_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{{"sources":{"a/main.sol":{"content":"pragma solidity ^0.8.0;\\nimport \\"./lib/L.sol\\";\\ncontract %s {}"},"a/lib/L.sol":{"content":"pragma solidity ^0.8.0;\\nlibrary L%d {}"}}}}', "n_name", "n_nationkey")
    return table(spark, sf_dir, "nation").where("n_name NOT LIKE '% %'").select("n_nationkey", flattened(text).alias("code"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS sc01, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS sc10 FROM labels""")
def category_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = multi_hot_array(F.array_compact(F.array(F.when(F.col("toxic") == 1, "sc01:2025"), F.when(F.col("quality") == 1, " SC10"), F.lit("SC99"))))
    return table(spark, sf_dir, "labels").select("doc_id", v.alias("v")).select("doc_id", F.col("v")[0].alias("sc01"), F.col("v")[7].alias("sc10"))


@query()
def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of the whole text of every document; the hash is not in SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", hashed_text(F.col("text"), 32).alias("vector"))
