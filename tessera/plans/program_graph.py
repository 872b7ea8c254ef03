"""From parsed texts to a labelled program graph and its training tables.

Every step is a join or an aggregate keyed by project, so one run does all projects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.code_text import normalized, squeezed, squeezed_lines
from tessera.functions.features import multi_hot_array
from tessera.functions.graph_text import cfg_edge_type
from tessera.operators import graphs, labels, linking
from tessera.operators.ordered import keep_first

#: kinds of syntax nodes that may stand for a control-flow expression
LINKED_KINDS = ("expressionstatement", "variabledeclarationstatement", "return", "emitstatement", "revertstatement", "ifstatement", "whilestatement", "forstatement", "assignment", "functioncall", "binaryoperation", "unaryoperation", "variabledeclaration", "throw")


@dataclass
class ProgramGraph:
    """nodes: project, node_id, node_type, sub_node_type, label, file, contract, function, args, expression, ir.
    edges: project, src, dst, edge_type, sub_edge_type, variable."""

    nodes: DataFrame
    edges: DataFrame

    def relations(self, by: str = "edge_type") -> DataFrame:
        kind = self.nodes.select("project", "node_id", "node_type")
        a = kind.select("project", F.col("node_id").alias("src"), F.col("node_type").alias("src_type"))
        b = kind.select("project", F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type"))
        return self.edges.join(a, ["project", "src"]).join(b, ["project", "dst"]).select("project", "src_type", F.col(by).alias("etype"), "dst_type", "src", "dst")

    def collapsed(self) -> ProgramGraph:
        """At most one edge per (src, dst): of each attribute the last that isn't null, in order of writing."""
        rank = F.when(F.col("edge_type") == "ast_child", 0).when(F.col("edge_type") == "cf", 1).when(F.col("edge_type") == "ast_to_cfg", 2).when(F.col("edge_type").isin("call", "return_call"), 3).otherwise(4)
        ranked = self.edges.withColumn("_o", rank).withColumn("_v", F.coalesce("variable", F.lit("")))
        return ProgramGraph(self.nodes, graphs.upsert_edges(ranked, ["project", "src", "dst"], ["_o", "_v"], ["edge_type", "sub_edge_type", "variable"]))

    def ablated(self, node_type: str) -> ProgramGraph:
        """Without the nodes of a type and the edges at them."""
        kept = self.nodes.where(F.col("node_type") != node_type)
        ids = kept.select("project", "node_id")
        edges = self.edges.join(ids.withColumnRenamed("node_id", "src"), ["project", "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), ["project", "dst"], "left_semi")
        return ProgramGraph(kept, edges)

    def message_sum(self, vectors: DataFrame, dims: list[str], how: str = "sum") -> DataFrame:
        return graphs.message_aggregate(self.edges, vectors, "node_id", dims, how)

    def readout(self, features: DataFrame, graph: str, dims: list[str]) -> DataFrame:
        """Sums of the feature columns per graph and node type."""
        return features.groupBy(graph, "node_type").agg(*[F.sum(d).alias(d) for d in dims])


def merge(tree: DataFrame, cfg_nodes: DataFrame, cfg_edges: DataFrame) -> ProgramGraph:
    """One id space: per project syntax nodes first, then control-flow nodes; edges whose ends are gone are dropped.

    tree: project, unit, node_no, parent_no, node_type, label, file, contract, function, args.
    cfg_nodes: project, dot, name, label, file, contract, function, sub_node_type, expression, ir.
    """
    signature = F.split_part(F.coalesce("function", F.lit("")), F.lit("("), F.lit(1))
    a = tree.select("project", F.lit("ast_node").alias("node_type"), F.lower("node_type").alias("sub_node_type"), "label", "file", "contract", "function", F.coalesce("args", F.lit("")).alias("args"), F.col("label").alias("expression"), F.lit("").alias("ir"), F.concat_ws("|", "unit", F.lpad(F.col("node_no").cast("string"), 10, "0")).alias("key"))
    c = cfg_nodes.select("project", F.lit("cfg_node").alias("node_type"), "sub_node_type", "label", "file", "contract", signature.alias("function"), F.regexp_extract("function", r"\((.*)\)", 1).alias("args"), "expression", "ir", F.concat_ws("|", "dot", "name").alias("key"))
    numbered = a.unionByName(c).withColumn("node_id", F.row_number().over(W.partitionBy("project").orderBy("node_type", "key")).cast("long") - 1)
    ids = numbered.select("project", "node_type", "key", "node_id")
    of = lambda t, name: ids.where(F.col("node_type") == t).select("project", F.col("key").alias(f"_{name}"), F.col("node_id").alias(name))
    place = lambda c: F.concat_ws("|", "unit", F.lpad(F.col(c).cast("string"), 10, "0"))
    below = tree.where("parent_no IS NOT NULL").select("project", place("parent_no").alias("_src"), place("node_no").alias("_dst"))
    child = below.join(of("ast_node", "src"), ["project", "_src"]).join(of("ast_node", "dst"), ["project", "_dst"]).select("project", "src", "dst", F.lit("ast_child").alias("edge_type"), F.lit(None).cast("string").alias("sub_edge_type"))
    flow = cfg_edges.select("project", F.concat_ws("|", "dot", "src_raw").alias("_src"), F.concat_ws("|", "dot", "dst_raw").alias("_dst"), "label")
    flow = flow.join(of("cfg_node", "src"), ["project", "_src"]).join(of("cfg_node", "dst"), ["project", "_dst"])
    s = numbered.select("project", F.col("node_id").alias("src"), F.col("sub_node_type").alias("_st"), F.col("ir").alias("_si"))
    d = numbered.select("project", F.col("node_id").alias("dst"), F.col("expression").alias("_de"))
    cf = flow.join(s, ["project", "src"]).join(d, ["project", "dst"]).select("project", "src", "dst", F.lit("cf").alias("edge_type"), cfg_edge_type(F.col("_st"), F.col("_si"), F.col("_de"), F.col("label")).alias("sub_edge_type"))
    cf = cf.dropDuplicates(["project", "src", "dst", "sub_edge_type"])
    return ProgramGraph(numbered.drop("key"), child.unionByName(cf).withColumn("variable", F.lit(None).cast("string")))


def _edges(df: DataFrame, kind: str, sub: str | Column, variable: Column | None = None) -> DataFrame:
    return df.select("project", "src", "dst", F.lit(kind).alias("edge_type"), (F.lit(sub) if isinstance(sub, str) else sub).alias("sub_edge_type"), (F.lit(None).cast("string") if variable is None else variable).alias("variable"))


def link_functions(g: ProgramGraph) -> DataFrame:
    """ast_to_cfg edges from function definitions to the entry node of the same file, contract, name and arguments.

    Entry nodes are those no flow edge ends at; of several the one of sub-type entry_point, then the last.
    """
    key = ["project", "file", "contract", "function", "args"]
    ended = g.edges.where("edge_type = 'cf'").select("project", F.col("dst").alias("node_id"))
    entries = g.nodes.where("node_type = 'cfg_node'").join(ended, ["project", "node_id"], "left_anti")
    entries = keep_first(entries, key, [F.col("sub_node_type") != "entry_point", F.desc("node_id")])
    defs = keep_first(g.nodes.where("node_type = 'ast_node' AND sub_node_type IN ('functiondefinition', 'modifierdefinition')"), key, [F.desc("node_id")])
    return _edges(defs.select(*key, F.col("node_id").alias("src")).join(entries.select(*key, F.col("node_id").alias("dst")), key), "ast_to_cfg", "function_definition")


def link_expressions(g: ProgramGraph) -> DataFrame:
    """ast_to_cfg edges from statements to the first control-flow node of the same normal form in the same function."""
    key = ["project", "file", "contract", "function", "_code"]
    coded = g.nodes.where(squeezed(F.col("expression")) != "").withColumn("_code", normalized("expression"))
    blocks = coded.where("node_type = 'cfg_node'").groupBy(*key).agg(F.min("node_id").alias("dst"))
    statements = coded.where((F.col("node_type") == "ast_node") & F.col("sub_node_type").isin(*LINKED_KINDS)).select(*key, F.col("node_id").alias("src"))
    return _edges(statements.join(blocks, key), "ast_to_cfg", "expression")


_SITE = [
    ("INTERNAL", r"INTERNAL_CALL,\s*(\w+)\.(\w+)\(([^)]*)\)"),
    ("LIBRARY", r"LIBRARY_CALL, dest:(\w+), function:(?:\w+\.)?(\w+)\(([^)]*)\)"),
    ("MODIFIER", r"MODIFIER_CALL,\s*(\w+)\.(\w+)\(([^)]*)\)"),
    ("HIGH_LEVEL", r"HIGH_LEVEL_CALL, dest:\w+\((\w+)\), function:(\w+)()"),
    ("LOW_LEVEL", r"LOW_LEVEL_CALL, dest:\w+\((\w+)\), function:(\w+)()"),
]


def call_sites(g: ProgramGraph) -> DataFrame:
    """project, src, call_type, target_contract, target_function, site_args of every call line; low-level calls too."""
    lines = g.nodes.where("node_type = 'cfg_node' AND ir <> ''").select("project", F.col("node_id").alias("src"), F.explode(F.split("ir", "\n")).alias("line"))
    kind = part = None
    take = lambda p: F.array(*[F.regexp_extract("line", p, i) for i in (1, 2, 3)])
    for name, p in _SITE:
        hit = F.col("line").rlike(p)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        part = F.when(hit, take(p)) if part is None else part.when(hit, take(p))
    return lines.withColumn("call_type", kind).where("call_type IS NOT NULL").withColumn("_p", part).select("project", "src", "call_type", F.col("_p")[0].alias("target_contract"), F.col("_p")[1].alias("target_function"), F.regexp_replace(F.col("_p")[2], r"\s", "").alias("site_args"))


def link_calls(g: ProgramGraph) -> DataFrame:
    """call edges from sites to entry nodes, and return_call edges from the targets' returns to what follows the site."""
    entries = link_functions(g).select("project", F.col("dst").alias("node_id")).join(g.nodes, ["project", "node_id"]).select("project", F.col("contract").alias("target_contract"), F.col("function").alias("target_function"), "args", F.col("node_id").alias("dst"), "file")
    sites = call_sites(g).where("call_type <> 'LOW_LEVEL'").distinct()
    found = linking.resolve_calls(sites, entries, ["project", "src", "call_type", "target_contract", "target_function", "site_args"], ["project", "target_contract", "target_function"], "site_args", "args")
    calls = _edges(found, "call", F.col("call_type")).distinct()
    returns = g.nodes.where("sub_node_type = 'return'").select("project", "file", F.col("contract").alias("target_contract"), F.col("function").alias("target_function"), "args", F.col("node_id").alias("_ret"))
    after = g.edges.where("edge_type = 'cf'").select("project", "src", F.col("dst").alias("_next"))
    back = found.select("project", "src", "file", "target_contract", "target_function", "args", "call_type").join(returns, ["project", "file", "target_contract", "target_function", "args"]).join(after, ["project", "src"])
    return calls.unionByName(_edges(back.select("project", F.col("_ret").alias("src"), F.col("_next").alias("dst"), "call_type"), "return_call", F.col("call_type")).distinct())


def link_data_flow(g: ProgramGraph, ir: DataFrame, counted_n_names: bool = True) -> DataFrame:
    """df edges from each definition of a variable to all its later uses in the function (no kill).

    ir: project, file, contract, function, args, ord, expr_md5, instrs. With counted_n_names false,
    variables that begin with n are not uses.
    """
    key = ["project", "file", "contract", "function"]
    nodes = g.nodes.where("node_type = 'cfg_node'").select(*key, F.md5("expression").alias("expr_md5"), "node_id")
    at = ir.join(nodes, [*key, "expr_md5"]).select(*key, "args", "ord", "node_id", F.explode("instrs").alias("x"))
    defs = at.select(*key, "args", "ord", "node_id", F.explode("x.defs").alias("variable"))
    uses = at.select(*key, "args", "ord", "node_id", F.explode("x.uses").alias("variable"))
    if not counted_n_names:
        uses = uses.where("variable NOT LIKE 'n%'")
    pairs = linking.def_use(defs, uses, [*key, "args", "variable"], "ord", "node_id")
    return _edges(pairs.select("project", F.col("def").alias("src"), F.col("use").alias("dst"), "variable").distinct(), "df", F.lit(None).cast("string"), F.col("variable"))


def match_findings(g: ProgramGraph, findings: DataFrame, sources: DataFrame) -> DataFrame:
    """project, finding_key, node_id: nodes of the finding's file and function that lie in its lines, or whose code stands in its snippet.

    findings: project, finding_key, file, function, line_from, line_to (null without lines), snippet;
    sources: project, file, text. A finding without lines takes every node with code in its function.
    """
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    code = g.nodes.where(squeezed(F.col("expression")) != "").select("project", base.alias("file"), "function", "node_id", squeezed(F.col("expression")).alias("_bare"), normalized("expression").alias("_code"))
    text = sources.select("project", base.alias("file"), "text").dropDuplicates(["project", "file"])
    # what is searched is made once a finding; a node adds two searches of its own code
    wanted = findings.select("project", "finding_key", base.alias("file"), "function", "line_from", "line_to", F.coalesce(F.regexp_replace("snippet", r"\s", ""), F.lit("")).alias("_snippet"))
    wanted = wanted.join(text, ["project", "file"], "left").select("project", "finding_key", "file", "function", F.col("line_from").isNull().alias("_whole"), squeezed_lines(F.col("text"), F.col("line_from"), F.col("line_to")).alias("_lines"), "_snippet")
    near = code.join(wanted, ["project", "file", "function"])
    inside, quoted = F.col("_lines").contains(F.col("_bare")), F.col("_snippet").contains(F.col("_code"))
    return near.where(F.col("_whole") | inside | quoted).select("project", "finding_key", "node_id").distinct()


def propagate_findings(g: ProgramGraph, matched: DataFrame) -> DataFrame:
    """matched, and the nodes one ast_to_cfg edge away, with the node each came from."""
    link = g.edges.where("edge_type = 'ast_to_cfg'").select("project", "src", "dst").distinct()
    both = link.unionByName(link.select("project", F.col("dst").alias("src"), F.col("src").alias("dst")))
    new = matched.join(both.select("project", F.col("src").alias("node_id"), F.col("dst").alias("_to")), ["project", "node_id"])
    new = new.groupBy("project", "finding_key", F.col("_to").alias("node_id")).agg(F.min(F.col("node_id")).alias("propagated_from")).join(matched, ["project", "finding_key", "node_id"], "left_anti")
    return matched.withColumn("propagated_from", F.lit(None).cast("long")).unionByName(new)


def membership(g: ProgramGraph) -> DataFrame:
    """project, file, contract, function, node_id. A node without contract, file or function joins its neighbours' contracts.

    One job looks whether there are such nodes; where there are none, no edge is read.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "None")
    known = g.nodes.where(~full("file") & ~full("contract"))
    own = known.select("project", "file", "contract", F.when(~full("function"), F.col("function")).alias("function"), "node_id")
    orphans = g.nodes.where(full("file") | full("contract") | full("function")).select("project", "node_id")
    if orphans.isEmpty():
        return own.distinct()
    ends = g.edges.select("project", F.col("src").alias("node_id"), F.col("dst").alias("_o")).unionByName(g.edges.select("project", F.col("dst").alias("node_id"), F.col("src").alias("_o")))
    ends = ends.join(orphans.withColumnRenamed("node_id", "_o"), ["project", "_o"], "left_semi")
    adopted = own.select("project", "file", "contract", "node_id").join(ends, ["project", "node_id"]).select("project", "file", "contract", F.lit(None).cast("string").alias("function"), F.col("_o").alias("node_id"))
    return own.unionByName(adopted.select(own.columns)).distinct()


def stage_labels(members: DataFrame, node_findings: DataFrame) -> dict[str, DataFrame]:
    """contract and function tables with `label` (any finding below), and nodes with their eight-wide label.

    node_findings: project, node_id, category.
    """
    hot = node_findings.groupBy("project", "node_id").agg(multi_hot_array(F.collect_set("category")).alias("label"))
    flagged = members.join(hot.select("project", "node_id", F.lit(1).alias("hit")), ["project", "node_id"], "left")
    # contracts from their functions, so that rows shrink before the second shuffle
    below = flagged.groupBy("project", "file", "contract", "function").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("label"))
    contracts = below.groupBy("project", "file", "contract").agg(F.max("label").alias("label"))
    return {"contract": contracts, "function": below.where("function IS NOT NULL"), "node": hot}


def contract_cuts(g: ProgramGraph, members: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each contract with what it reaches in `hops`; groups of under two nodes or one edge are left out."""
    group = F.concat_ws("@", "project", "file", "contract")
    seeds = members.select(group.alias("graph"), F.concat_ws("#", "project", F.col("node_id")).alias("node"))
    edges = g.edges.select(F.concat_ws("#", "project", F.col("src")).alias("src"), F.concat_ws("#", "project", F.col("dst")).alias("dst")).distinct()
    inside = graphs.khop(seeds, edges, "graph", "node", hops)
    cut = graphs.induced(inside, edges, "graph", "node")
    kept = graphs.drop_tiny(inside, cut, "graph").select("graph")
    return inside.join(kept, "graph", "left_semi"), cut.join(kept, "graph", "left_semi")


def function_choice(functions: DataFrame, most_negative: int = 2) -> DataFrame:
    """All functions of label 1 and the first of label 0 of each project, by name."""
    w = W.partitionBy("project", "label").orderBy("file", "contract", "function")
    return functions.withColumn("_n", F.row_number().over(w)).where((F.col("label") == 1) | (F.col("_n") <= most_negative)).drop("_n")


def build(tree: DataFrame, cfg_nodes: DataFrame, cfg_edges: DataFrame, ir: DataFrame) -> ProgramGraph:
    """The whole graph of all projects, as a multigraph."""
    g = merge(tree, cfg_nodes, cfg_edges)
    linked = g.edges.unionByName(link_functions(g)).unionByName(link_expressions(g)).unionByName(link_calls(g)).unionByName(link_data_flow(g, ir))
    return ProgramGraph(g.nodes, linked)


def outcomes(g: ProgramGraph, matched: DataFrame, projects: DataFrame) -> DataFrame:
    """project, category: success, benign or failed."""
    n = g.nodes.groupBy("project").agg(F.bool_or(F.col("node_type") == "cfg_node").alias("c"), F.bool_or(F.col("node_type") == "ast_node").alias("a"))
    e = g.edges.groupBy("project").agg(F.bool_or(F.col("edge_type") == "cf").alias("f"))
    m = matched.groupBy("project").agg(F.count("*").alias("m"))
    joined = projects.select("project").distinct().join(n, "project", "left").join(e, "project", "left").join(m, "project", "left")
    return joined.select("project", labels.outcome(F.col("c") & F.coalesce("f", F.lit(False)), F.col("a"), F.coalesce("m", F.lit(0))).alias("category"))
