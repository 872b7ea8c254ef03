"""Raw texts of one small project through the readers, the graph, its labels and cuts."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import code_text, graph_text, ir
from tessera.plans import program_graph as P
from tessera.sources import readers, writers


def _ident(n):
    return {"nodeType": "Identifier", "name": n}


TREE = {
    "nodeType": "SourceUnit", "absolutePath": "src/Bank.sol",
    "nodes": [
        {"nodeType": "PragmaDirective", "literals": ["solidity"]},
        {"nodeType": "ContractDefinition", "name": "Bank", "contractKind": "contract", "nodes": [
            {"nodeType": "FunctionDefinition", "name": "pay", "parameters": {"parameters": [{"nodeType": "VariableDeclaration", "name": "n", "typeName": {"nodeType": "ElementaryTypeName", "name": "uint"}}]},
             "body": {"nodeType": "Block", "statements": [{"nodeType": "ExpressionStatement", "expression": {"nodeType": "Assignment", "operator": "=", "leftHandSide": _ident("total"), "rightHandSide": {"nodeType": "BinaryOperation", "operator": "+", "leftExpression": _ident("total"), "rightExpression": _ident("n")}}}]}},
        ]},
    ],
}
DOT = 'digraph{ 0[label="Node Type: ENTRY_POINT 0\n"]; 0->1; 1[label="Node Type: EXPRESSION 1\n\nEXPRESSION:\ntotal = (total + n)\n\nIRs:\nTMP_0(uint256) = total + n\ntotal(uint256) := TMP_0(uint256)"]; 1->2[label="True"]; 2[label="Node Type: RETURN 2\n\nEXPRESSION:\ntotal\n\nIRs:\nRETURN total"]; }'
IR = "Contract Bank\n\tFunction Bank.pay(uint256)\n\t\tExpression: total = (total + n)\n\t\tIRs:\n\t\t\tTMP_0(uint256) = total + n\n\t\t\ttotal(uint256) := TMP_0(uint256)\n\t\tExpression: total\n\t\tIRs:\n\t\t\tRETURN total\n"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in (("ast/Bank_ast.json", json.dumps(TREE)), ("ast/bad.json", "{"), ("cfg/Bank.sol-Bank-pay(uint256).dot", DOT), ("ir/ir_Bank.sol.json", json.dumps({"results": {"printers": [{"description": IR}]}}))):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    tree = readers.syntax_trees(spark, str(root / "ast")).withColumn("project", F.lit("p"))
    nodes, edges = (d.withColumn("project", F.lit("p")) for d in readers.control_flow(spark, str(root / "cfg")))
    code = readers.intermediate_code(spark, str(root / "ir")).withColumn("project", F.lit("p"))
    return tree, nodes, edges, code


@pytest.fixture(scope="module")
def graph(project):
    g = P.build(*project)
    return P.ProgramGraph(g.nodes.cache(), g.edges.cache())


def test_tree_rows(project):
    rows = {r.label: r for r in project[0].collect()}
    assert set(rows) == {"File: Bank.sol", "Contract: Bank", "pay(uint n)", "Block", "total = (total + n)"}
    assert rows["pay(uint n)"].args == "uint256" and rows["Block"].function == "pay"
    assert json.loads(rows["Contract: Bank"].ml)["contract_kind"] == "contract"


def test_ir_rows(project):
    rows = sorted(project[3].collect(), key=lambda r: r.ord)
    assert [(r.file, r.contract, r.function, r.args, r.expression) for r in rows] == [("Bank.sol", "Bank", "pay", "(uint256)", "total = (total + n)"), ("Bank.sol", "Bank", "pay", "(uint256)", "total")]
    assert [(i.kind, i.defs, i.uses) for i in rows[0].instrs] == [("binary_operation", ["TMP_0"], ["total", "n"]), ("assign", ["total"], ["TMP_0"])]


def test_edges_of_all_kinds(graph):
    kinds = {(r.edge_type, r.sub_edge_type) for r in graph.edges.collect()}
    assert {("ast_child", None), ("cf", "cf"), ("cf", "cf_true"), ("ast_to_cfg", "function_definition"), ("ast_to_cfg", "expression"), ("df", None)} <= kinds


def test_one_edge_per_pair_when_collapsed(graph):
    c = graph.collapsed().edges
    assert c.count() == c.select("src", "dst").distinct().count()
    row = c.where("edge_type = 'df'").first()
    assert row.sub_edge_type == "cf_true" and row.variable == "total"


def test_findings_labels_and_cuts(spark, graph):
    findings = spark.createDataFrame([("p", "k1", "x/Bank.sol", "pay", 2, 2, "total = (total + n);")], "project string, finding_key string, file string, function string, line_from int, line_to int, snippet string")
    sources = spark.createDataFrame([("p", "Bank.sol", "function pay(uint n) {\n  total = (total + n);\n}")], "project string, file string, text string")
    matched = P.match_findings(graph, findings, sources)
    assert matched.count() >= 2
    spread = P.propagate_findings(graph, matched)
    assert spread.count() >= matched.count()
    members = P.membership(graph)
    labels = P.stage_labels(members, matched.withColumn("category", F.lit("SC05:2025")))
    assert [r.label for r in labels["contract"].collect()] == [1]
    assert labels["node"].first().label == [0, 0, 0, 1, 0, 0, 0, 0]
    inside, cut = P.contract_cuts(graph, members)
    assert inside.count() >= 2 and cut.count() >= 1
    assert P.outcomes(graph, matched, findings).first().category == "success"
    assert P.function_choice(labels["function"]).count() == 1
    assert writers.build_summary(graph.nodes.withColumn("node_type", F.col("node_type")), graph.edges, matched, findings).count() >= 4


def test_dot_text_can_be_read_again(spark, graph):
    nodes = graph.nodes.select("project", "node_id", "label")
    edges = graph.edges.select("project", "src", "dst", F.col("edge_type").alias("label"))
    text = "\n".join(r.line for r in writers.dot_lines(nodes, edges, "project").orderBy("part", "line").collect())
    rows = list(graph_text.parse_dot(text))
    assert sum(r[0] == "node" for r in rows) == nodes.count() and sum(r[0] == "edge" for r in rows) == edges.count()


def test_code_forms():
    assert code_text.normalize_code("require(bool,string)(a > b, f(uint256)(x))") == "require(a>b,f(x))"
    assert code_text.normalize_code(None) == ""
    assert code_text.find_span("a;\nb  ;\na;", "a;", 2, 3) == (3, 3)
    assert code_text.find_span("a", "zz") is None
    assert code_text.import_order({"a": 'import "b";', "b": 'import "a";', "c": ""}) == ["b", "a", "c"]
    flat = code_text.flatten_source(json.dumps({"a.sol": {"content": 'import "./b.sol";\ncontract X {}'}, "b.sol": {"content": "contract X {}"}}))
    assert flat.index("contract X {}") < flat.index("contract a_X {}")


def test_ir_roles_and_returns():
    assert [ir.role_and_version(x) for x in ("TMP_1", "REF_2", "a_3", "b")] == [("tmp", ""), ("ref", ""), ("var", "3"), ("var", "")]
    assert [i["uses"] for i in ir.instructions("RETURN (a, True, 5)\nCONDITION x_1\nEND_IF")] == [["a"], ["x_1"], []]


def test_broken_dot_is_an_error_row():
    with pytest.raises(ValueError):
        list(graph_text.parse_dot('digraph { a [label="x"'))


def test_tables_of_text(spark, tmp_path):
    (tmp_path / "tax.csv").write_text("swc_id,owasp_id,check\nSWC-1, SC01 ,\nSWC-2,SC02,X\n")
    assert [tuple(r) for r in readers.taxonomy(spark, str(tmp_path / "tax.csv")).collect()] == [("SWC-1", "SC01")]
    a = "0x" + "ab" * 20
    (tmp_path / "adr.csv").write_text(f"address,tx_count\n{a},x\n0x12,5\n{a[:-1]}c,9\n")
    assert [r.tx_count for r in readers.addresses(spark, str(tmp_path / "adr.csv")).collect()] == [9, 0]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/result.log").write_text("INFO:symExec:/a/B.sol:12:3: Warning: Integer Overflow.\n    x + y\n/a/B.sol:1:1: Warning: Other.\n")
    assert [(r.line, r.name, r.snippet) for r in readers.analyser_logs(spark, str(tmp_path / "logs")).collect()] == [(12, "Integer Overflow", "x + y")]
    (tmp_path / "form").mkdir()
    (tmp_path / "form/p1.json").write_text(json.dumps({"filePath": "a.sol", "SWCs": [{"category": "SWC-107-Reentrancy", "function": "f", "lineNumber": "L1-L2"}]}))
    assert readers.findings_by_file(spark, str(tmp_path / "form"), "source").first().category == "SWC-107-Reentrancy"
    out = readers.compiler_output(spark.createDataFrame([("p", "x\n======= a.sol =======\n{1}\n======= b.sol =======\n{2}\n")], "p string, t string"), "t")
    assert [tuple(r) for r in out.collect()] == [("p", "a.sol", "{1}"), ("p", "b.sol", "{2}")]


@pytest.mark.parametrize("name", ["graph_findings", "graph_stage_labels"])
def test_no_row_of_the_graph_goes_to_python(spark, sf_dir, name):
    from tessera.plans import catalogue

    assert "EvalPython" not in catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_only_nodes_without_a_place_make_edges_read(spark):
    place = "project string, node_id long, file string, contract string, function string"
    nodes = spark.createDataFrame([("p", 1, "a", "K", "f"), ("p", 2, "a", "K", "g")], place)
    edges = spark.createDataFrame([("p", 1, 3), ("p", 3, 2), ("p", 2, 4), ("p", 1, 4), ("p", 1, 2)], "project string, src long, dst long")
    assert "src" not in P.membership(P.ProgramGraph(nodes, edges))._jdf.queryExecution().analyzed().toString()
    more = nodes.unionByName(spark.createDataFrame([("p", 3, "", None, "None"), ("p", 4, "b", "L", ""), ("p", 5, None, None, None)], place))
    members = P.membership(P.ProgramGraph(more, edges))
    assert sorted(map(tuple, members.fillna("-").collect())) == [("p", "a", "K", "-", 3), ("p", "a", "K", "-", 4), ("p", "a", "K", "f", 1), ("p", "a", "K", "g", 2), ("p", "b", "L", "-", 4)]
    found = P.stage_labels(members, spark.createDataFrame([("p", 4, "SC01")], "project string, node_id long, category string"))
    assert sorted(map(tuple, found["contract"].collect())) == [("p", "a", "K", 1), ("p", "b", "L", 1)]
    assert sorted(map(tuple, found["function"].collect())) == [("p", "a", "K", "f", 0), ("p", "a", "K", "g", 0)]
