"""Queries of the readers: small files are made from the 25 nations, written to the shared folder, read, and checked by SQL.

The shared folder is the one spark.checkpoint.dir names, or one of this machine's own where the session runs on it alone.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalogue import query
from tessera.sources import readers, table


def _written(spark: SparkSession, files: dict[str, str]) -> str:
    """The path of a new folder with the files, by name."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{(folder or 'file://' + tempfile.gettempdir() + '/tessera-checkpoints').rstrip('/')}/files-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, text in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    return root


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """Keys of the nations, 25 at every size, and of their regions."""
    return sorted((r.n_nationkey, r.n_regionkey) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())


def _unit(k: int, functions: int) -> str:
    parts = [{"nodeType": "FunctionDefinition", "name": f"f{i}", "body": {"nodeType": "Block", "statements": [{"nodeType": "Return", "expression": {"nodeType": "Identifier", "name": "x"}}] * (i % 2)}} for i in range(functions)]
    return json.dumps({"nodeType": "SourceUnit", "absolutePath": f"src/N{k}.sol", "nodes": [{"nodeType": "PragmaDirective"}, {"nodeType": "ContractDefinition", "name": f"C{k}", "contractKind": "contract", "nodes": parts}]})


@query("""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 7 THEN 5 ELSE n_regionkey + 1 END AS f, CASE WHEN n_nationkey = 7 THEN 'z7.json' ELSE 'n' || n_nationkey || '.json' END AS unit FROM nation)
  SELECT unit, 'SourceUnit' AS node_type, 1::BIGINT AS n FROM n UNION ALL SELECT unit, 'ContractDefinition', 1 FROM n UNION ALL SELECT unit, 'FunctionDefinition', f FROM n UNION ALL SELECT unit, 'Block', f FROM n
  UNION ALL SELECT unit, 'Return', f // 2 FROM n WHERE f > 1""")
def read_syntax_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree a file; one unit stands in two files, of which the last holds, and one file isn't JSON."""
    files = {f"ast/n{k}.json": _unit(k, r + 1) for k, r in _nations(spark, sf_dir)} | {"ast/z7.json": _unit(7, 5), "ast/broken.json": "{", "ast/note.txt": "x"}
    return readers.syntax_trees(spark, _written(spark, files) + "/ast").groupBy(F.regexp_extract("unit", "([^/]+)$", 1).alias("unit"), "node_type").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT n_nationkey AS k, 'N' || n_nationkey || '.sol' AS file, 'C' || n_nationkey AS contract FROM nation)
  SELECT file, contract, 'f(uint256)' AS function, '0' AS name, 'entry_point' AS sub_node_type, '' AS expression, 1::BIGINT AS n_out FROM k
  UNION ALL SELECT file, contract, 'f(uint256)', '1', 'if', 'a > ' || k, 2 FROM k UNION ALL SELECT file, contract, 'f(uint256)', '2', 'return', 'a', 0 FROM k
  UNION ALL SELECT file, contract, 'f(uint256)', '3', 'new variable', 'b = ' || k, 1 FROM k""")
def read_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions as DOT texts, one node of each inside a subgraph, with quoted labels of several lines."""
    dot = 'digraph{{ 0[label="Node Type: ENTRY_POINT 0\n"]; 0->1; 1[label="Node Type: IF 1\n\nEXPRESSION:\na > {0}\n\nIRs:\nTMP_0 = a > {0}"]; 1->3[label="True"]; 1->2[label="False"]; subgraph s {{ 3[label="Node Type: NEW VARIABLE 3\n\nEXPRESSION:\nb = {0}"]; }} 3->2; 2[label="Node Type: RETURN 2\n\nEXPRESSION:\na\n\nIRs:\nRETURN a"]; }}'
    files = {f"N{k}.sol-C{k}-f(uint256).dot": dot.format(k) for k, _ in _nations(spark, sf_dir)}
    nodes, edges = readers.control_flow(spark, _written(spark, files))
    out = edges.groupBy("dot", F.col("src_raw").alias("name")).agg(F.count("*").alias("n_out"))
    return nodes.join(out, ["dot", "name"], "left").select("file", "contract", "function", "name", "sub_node_type", F.coalesce("expression", F.lit("")).alias("expression"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query("""WITH k AS (SELECT n_nationkey AS k, 'N' || n_nationkey || '.sol' AS file, 'C' || n_nationkey AS contract FROM nation)
  SELECT file, contract, 'f' AS function, '(uint256)' AS args, 0 AS ord, 'a = b + ' || k AS expression, 2 AS n_instrs, 'binary_operation' AS kind, 'TMP_0,a' AS defs, 'b,TMP_0' AS uses FROM k
  UNION ALL SELECT file, contract, 'f', '(uint256)', 1, 'g(a)', 1, 'call', '', 'a' FROM k
  UNION ALL SELECT file, contract, 'g', '(uint256)', 0, 'x', 1, 'return', '', 'x' FROM k WHERE k % 2 = 0
  UNION ALL SELECT file, contract, 'g', '(uint256)', 0, 'y', 2, 'phi', 'y_2,y_3', 'y_0,y_1,y_2' FROM k WHERE k % 2 = 1""")
def read_intermediate_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed code of two functions a contract; the first entry of f is printed twice and holds once."""

    def printed(k: int) -> str:
        last = "\t\tExpression: x\n\t\tIRs:\n\t\t\tRETURN x\n" if k % 2 == 0 else "\t\tExpression: y\n\t\tIRs:\n\t\t\ty_2(int8) := ϕ(['y_0', 'y_1'])\n\t\t\ty_3(int8) := y_2\n"
        first = f"\t\tExpression: a = b + {k}\n\t\tIRs:\n\t\t\tTMP_0(uint256) = b + {k}\n\t\t\ta(uint256) := TMP_0(uint256)\n"
        return f"Contract C{k}\n\tFunction C{k}.f(uint256)\n{first}{first}\t\tExpression: g(a)\n\t\tIRs:\n\t\t\tINTERNAL_CALL, C{k}.g(uint256)(a)\n\tFunction C{k}.g(uint256)\n{last}"

    files = {f"ir_N{k}.sol.json": json.dumps({"results": {"printers": [{"description": printed(k)}]}}) for k, _ in _nations(spark, sf_dir)}
    code = readers.intermediate_code(spark, _written(spark, files))
    flat = lambda field: F.array_join(F.flatten(F.col(f"instrs.{field}")), ",")
    return code.select("file", "contract", "function", "args", "ord", "expression", F.size("instrs").alias("n_instrs"), F.col("instrs")[0]["kind"].alias("kind"), flat("defs").alias("defs"), flat("uses").alias("uses"))


@query("""WITH k AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation)
  SELECT 'A' AS form, 'N' || k || '.sol' AS file, 'SWC-' || (100 + r) AS name, 'L' || k || '-L' || (k + r) AS lines FROM k UNION ALL SELECT 'A', 'N' || k || '.sol', 'SWC-100', 'L1' FROM k
  UNION ALL SELECT 'B', 'N' || k || '.sol', tool || ':' || v, k || '-' || (k + r) FROM k, (VALUES ('slither', 'reentrancy'), ('oyente', 'overflow'), ('oyente', 'origin')) t(tool, v)
  UNION ALL SELECT 'C', 'C' || k, 'access_control', (k + 1) || ',' || (k + 3) FROM k UNION ALL SELECT 'C', 'C' || k, 'arithmetic', k::VARCHAR FROM k WHERE r < 3""")
def read_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three forms of findings: by file, by tool, and label files of one category or of several."""
    keys = _nations(spark, sf_dir)
    files = {f"a/p{k}.json": json.dumps({"filePath": f"N{k}.sol", "SWCs": [{"category": f"SWC-{100 + r}", "function": "f", "lineNumber": f"L{k}-L{k + r}"}, {"category": "SWC-100", "function": "g", "lines": "L1"}]}) for k, r in keys} | {"a/bad.json": "["}
    issue = lambda name, k, r: {"name": name, "line": k, "line_end": k + r, "function": "f", "filename": "x", "contract": "C"}
    files |= {"b/all.json": json.dumps({f"N{k}.sol": {"slither": [issue("reentrancy", k, r)], "oyente": [issue("overflow", k, r), issue("origin", k, r)]} for k, r in keys})}
    files |= {"c/access.json": json.dumps([{"name": f"C{k}", "vulnerabilities": [{"lines": [k + 3, k + 1], "category": "ignored"}, {"lines": [k + 1], "category": "x"}]} for k, _ in keys])}
    files |= {"c/others.json": json.dumps([{"name": f"C{k}", "vulnerabilities": [{"lines": [k], "category": "arithmetic" if r < 3 else "unknown"}]} for k, r in keys])}
    root = _written(spark, files)
    a = readers.findings_by_file(spark, f"{root}/a", "source").select(F.lit("A").alias("form"), "file", F.col("category").alias("name"), "lines")
    b = readers.findings_by_tool(spark, f"{root}/b").select(F.lit("B"), "file", F.concat_ws(":", "tool", "name"), F.concat_ws("-", "line", "line_end"))
    c = readers.findings_by_category(spark, {f"{root}/c/access.json": "access_control", f"{root}/c/others.json": None}, ["arithmetic"]).select(F.lit("C"), "name", "category", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))
    return a.union(b).union(c)


@query("""SELECT '/x/N' || n_nationkey || '.sol' AS filename, n_nationkey + 1 AS line, CASE WHEN n_regionkey % 2 = 0 THEN 'Integer Overflow' ELSE 'Timestamp Dependency' END AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'a + ' || n_nationkey END AS snippet FROM nation""")
def read_analyser_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings in scope; a snippet is the indented line that follows."""
    log = lambda k, r: f"INFO:root:start\nINFO:symExec:/x/N{k}.sol:{k + 1}:5: Warning: {'Integer Overflow' if r % 2 == 0 else 'Timestamp Dependency'}.\n{'    a + ' + str(k) if r % 2 == 0 else 'next'}\n/x/N{k}.sol:9:9: Warning: Something Else.\n  z\n"
    files = {f"p{k}/deep/result.log": log(k, r) for k, r in _nations(spark, sf_dir)} | {"p0/other.log": "/x/Q.sol:1:1: Warning: Integer Overflow.\n  q\n"}
    return readers.analyser_logs(spark, _written(spark, files)).select("filename", "line", "name", "snippet")


@query("""WITH m AS (SELECT n_nationkey, 'SWC-' || (100 + n_regionkey) AS code, n_regionkey AS r FROM nation) SELECT n_nationkey, code, 'SC0' || (r + 1) AS category FROM m WHERE r < 4""")
def read_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy table whose rows checked x don't count, and findings mapped by it."""
    text = "swc_id,owasp_id,check\n" + "".join(f" swc-{100 + r},sc0{r + 1} ,{'X' if r == 4 else ''}\n" for r in range(5))
    known = readers.taxonomy(spark, _written(spark, {"t.csv": text}) + "/t.csv")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("SWC-"), F.col("n_regionkey") + 100).alias("code"))
    return nations.join(known, "code").select("n_nationkey", "code", "category")


@query("""SELECT '0x' || lpad(n_nationkey::VARCHAR, 40, 'a') AS address, CASE WHEN n_regionkey = 0 THEN 0 ELSE n_nationkey * 10 END::BIGINT AS tx_count FROM nation WHERE n_regionkey <> 4""")
def read_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with counts; bad counts are 0, bad addresses go."""
    row = lambda k, r: f" 0x{str(k).rjust(40, 'a') if r != 4 else 'zz'} ,{'many' if r == 0 else k * 10}\n"
    return readers.addresses(spark, _written(spark, {"a.csv": "address,tx_count\n" + "".join(row(k, r) for k, r in _nations(spark, sf_dir))}) + "/a.csv")


@query("""SELECT 'N' || n_nationkey || '.sol' AS source, '{"k":' || n_nationkey || '}' AS content FROM nation""")
def read_compiler_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "JSON AST:\n\n" + "".join(f'======= N{k}.sol =======\n{{"k":{k}}}\n\n' for k, _ in _nations(spark, sf_dir))
    return readers.compiler_output(spark.createDataFrame([(text,)], "text string"), "text")
