"""Queries of the program graph: orders are functions of a contract (their customer), lines their statements.

Every order is a function `f<order>` of contract `K<customer>` in project `p<customer>`: a syntax node
for its definition and each statement, and a control-flow node for its entry and each statement, in
one chain. A statement `v<a> = g(uint256)(v<b>)` stands with its types in control flow and without
them in the syntax tree; the last line of an order returns, the first calls the customer's next order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ir import parse_ir
from tessera.operators.graphs import stored
from tessera.plans import program_graph as P
from tessera.plans.catalogue import query
from tessera.sources import table

#: a function per order with a line, and its statements: place in the order, a and b, whether it is the last, the next order
_STATEMENTS = """f AS (SELECT o_orderkey AS o, o_custkey AS c, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)),
  l AS (SELECT l_orderkey AS o, l_linenumber AS line, min(l_partkey) % 3 AS a, min(l_suppkey) % 3 AS b FROM lineitem GROUP BY l_orderkey, l_linenumber),
  s AS (SELECT c, o, a, b, next, row_number() OVER w AS n, count(*) OVER (PARTITION BY o) AS size FROM l JOIN f USING (o) WINDOW w AS (PARTITION BY o ORDER BY line))"""
_FIRST = "min(n) OVER (PARTITION BY o, a, b)"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(f"WITH {_STATEMENTS} SELECT CAST(c AS bigint) AS c, CAST(o AS bigint) AS o, a, b, next, n, size FROM s")


def _graph(s: DataFrame) -> P.ProgramGraph:
    place = [F.concat(F.lit("p"), "c").alias("project"), F.lit("src/A.sol").alias("file"), F.concat(F.lit("K"), "c").alias("contract"), F.concat(F.lit("f"), "o").alias("function"), F.lit("uint256").alias("args")]

    def nodes(rows: DataFrame, at: str, kind: str, sub: str, expression: str, ir: str = "''") -> DataFrame:
        return rows.select(*place, F.expr(f"o * 100 + {at}").alias("node_id"), F.lit(kind).alias("node_type"), F.expr(sub).alias("sub_node_type"), F.expr(expression).alias("label"), F.expr(expression).alias("expression"), F.expr(ir).alias("ir"))

    functions = s.where("n = 1")
    call = "IF(n = 1 AND next IS NOT NULL, concat('TMP_1(uint256) = INTERNAL_CALL, K', c, '.f', next, '(uint256)(v', b, ')'), concat('v', a, '(uint256) := v', b, '(uint256)'))"
    all_nodes = (
        nodes(functions, "0", "ast_node", "'functiondefinition'", "concat('f', o, '(uint256 x)')")
        .unionByName(nodes(s, "n", "ast_node", "'expressionstatement'", "concat('v', a, ' = g(v', b, ')')"))
        .unionByName(nodes(functions, "50", "cfg_node", "'entry_point'", "''"))
        .unionByName(nodes(s, "50 + n", "cfg_node", "IF(n = size, 'return', 'expression')", "concat('v', a, '  =  g(uint256)(v', b, ')')", call))
    )
    flow = s.select(F.concat(F.lit("p"), "c").alias("project"), F.expr("o * 100 + 49 + n").alias("src"), F.expr("o * 100 + 50 + n").alias("dst"), F.lit("cf").alias("edge_type"), F.lit("cf").alias("sub_edge_type"), F.lit(None).cast("string").alias("variable"))
    return P.ProgramGraph(all_nodes, flow)


_PAIRS = "'p' || c AS project"


@query(f"WITH {_STATEMENTS} SELECT {_PAIRS}, o * 100 AS src, o * 100 + 50 AS dst, 'function_definition' AS sub_edge_type FROM s WHERE n = 1")
def graph_function_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.link_functions(_graph(_statements(spark, sf_dir))).select("project", "src", "dst", "sub_edge_type")


@query(f"WITH {_STATEMENTS} SELECT {_PAIRS}, o * 100 + n AS src, o * 100 + 50 + {_FIRST} AS dst FROM s")
def graph_expression_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.link_expressions(_graph(_statements(spark, sf_dir))).select("project", "src", "dst")


@query(f"""WITH {_STATEMENTS}, calls AS (SELECT c, o, next, size FROM s WHERE n = 1 AND next IN (SELECT o FROM s)), ends AS (SELECT o AS next, size AS last FROM s WHERE n = 1)
  SELECT {_PAIRS}, 'call' AS edge_type, o * 100 + 51 AS src, next * 100 + 50 AS dst FROM calls
  UNION SELECT {_PAIRS}, 'return_call', next * 100 + 50 + last, o * 100 + 52 FROM calls JOIN ends USING (next) WHERE size > 1""")
def graph_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.link_calls(_graph(_statements(spark, sf_dir))).select("project", "edge_type", "src", "dst")


@query(f"""WITH {_STATEMENTS}, m AS (SELECT * FROM s WHERE n > 1 OR next IS NULL), t AS (SELECT * FROM s WHERE n = 1 AND next IS NOT NULL),
  d AS (SELECT o, c, n, 'v' || a AS variable FROM m UNION ALL SELECT o, c, n, 'TMP_1' FROM t), u AS (SELECT o, n, 'v' || b AS variable FROM s)
  SELECT DISTINCT {_PAIRS}, o * 100 + 50 + d.n AS src, o * 100 + 50 + u.n AS dst, variable FROM d JOIN u USING (o, variable) WHERE d.n < u.n""")
def graph_data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement has an entry of its own, matched to its node by the digest of its expression and its number."""
    g = _graph(_statements(spark, sf_dir))
    nodes = g.nodes.withColumn("expression", F.when(F.col("node_type") == "cfg_node", F.concat("expression", F.lit("#"), "node_id")).otherwise(F.col("expression")))
    code = nodes.where("node_type = 'cfg_node' AND ir <> ''").select("project", "file", "contract", "function", "args", F.col("node_id").alias("ord"), F.md5("expression").alias("expr_md5"), parse_ir("ir").alias("instrs"))
    return P.link_data_flow(P.ProgramGraph(nodes, g.edges), code).select("project", "src", "dst", "variable")


def _found(spark: SparkSession, sf_dir: str) -> tuple[P.ProgramGraph, DataFrame]:
    """The graph with its links, and what findings match: in odd customers' first statement's line, else by a quoted snippet."""
    s = stored(_statements(spark, sf_dir))
    g = _graph(s)
    g = P.ProgramGraph(g.nodes, g.edges.unionByName(P.link_functions(g)).unionByName(P.link_expressions(g)))
    text = s.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "n", "a", "b"))), lambda x: F.concat(F.lit("  v"), x.a, F.lit(" = g(v"), x.b, F.lit(");"))), "\n").alias("text"))
    sources = text.select(F.concat(F.lit("p"), "c").alias("project"), F.lit("x/A.sol").alias("file"), "text")
    first = s.where("n = 1")
    findings = first.select(
        F.concat(F.lit("p"), "c").alias("project"), F.col("o").cast("string").alias("finding_key"), F.lit("A.sol").alias("file"), F.concat(F.lit("f"), "o").alias("function"),
        F.lit(0).alias("line_from"), F.lit(0).alias("line_to"), F.expr("IF(o % 2 = 1, concat('x; v', a, ' = g (v', b, ');'), 'nothing')").alias("snippet"),
    )
    return g, P.match_findings(g, findings, sources)


_MATCHED = f"""{_STATEMENTS}, k AS (SELECT o, a AS fa, b AS fb FROM s WHERE n = 1 AND o % 2 = 1),
  m AS (SELECT c, o, n, {_FIRST} AS first FROM s JOIN k USING (o) WHERE a = fa AND b = fb)"""


@query(f"""WITH {_MATCHED} SELECT {_PAIRS}, o::VARCHAR AS finding_key, o * 100 + n AS node_id, NULL::BIGINT AS propagated_from FROM m
  UNION ALL SELECT 'p' || c, o::VARCHAR, o * 100 + 50 + n, NULL FROM m""")
def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by a quoted snippet; the nodes one link away match themselves, so nothing new is propagated."""
    g, matched = _found(spark, sf_dir)
    return P.propagate_findings(g, matched).select("project", "finding_key", "node_id", "propagated_from")


@query(f"""WITH {_STATEMENTS} SELECT 'p' || c AS project, 'K' || c AS contract, 'f' || o AS function, (o % 2 = 1)::INT AS label FROM s WHERE n = 1
  UNION ALL SELECT 'p' || c, 'K' || c, NULL, max((o % 2 = 1)::INT) FROM s WHERE n = 1 GROUP BY c""")
def graph_stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, matched = _found(spark, sf_dir)
    stages = P.stage_labels(P.membership(g), matched.select("project", "node_id", F.lit("SC01").alias("category")))
    none = F.lit(None).cast("string").alias("function")
    return stages["function"].select("project", "contract", "function", "label").unionByName(stages["contract"].select("project", "contract", none, "label"))


@query(f"""WITH {_STATEMENTS}, x AS (SELECT c, o, n, 'ast_node' AS t, o * 100 + n AS id FROM s UNION ALL SELECT c, o, 0, 'ast_node', o * 100 FROM s WHERE n = 1 UNION ALL SELECT c, o, n, 'cfg_node', o * 100 + 50 + n FROM s UNION ALL SELECT c, o, 0, 'cfg_node', o * 100 + 50 FROM s WHERE n = 1)
  SELECT 'p' || c AS project, t AS node_type, count(*) AS n_nodes, sum(id)::DOUBLE AS total, 0 AS n_edges FROM x WHERE t = 'ast_node' GROUP BY ALL""")
def graph_ablation_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without control-flow nodes no edge is left; sums of a feature per project and node type."""
    g = _graph(_statements(spark, sf_dir))
    kept = P.ProgramGraph(g.nodes, g.edges.unionByName(P.link_functions(g))).ablated("cfg_node")
    features = kept.nodes.select("project", "node_type", F.lit(1.0).alias("one"), F.col("node_id").cast("double").alias("id"))
    sums = kept.readout(features, "project", ["one", "id"])
    edges = kept.edges.groupBy("project").agg(F.count("*").alias("k"))
    return sums.join(edges, "project", "left").select("project", "node_type", F.col("one").cast("long").alias("n_nodes"), F.col("id").alias("total"), F.coalesce("k", F.lit(0)).cast("int").alias("n_edges"))
