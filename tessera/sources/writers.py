"""Writers: partitioned tables, shards, routed projects, DOT texts, summaries, the step ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.labels import hash_share
from tessera.operators.ordered import chunks, keep_first

SHARD_ITEMS = 500


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, partition: tuple[str, ...] = ("source", "category")) -> None:
    """Both tables of a graph, partitioned; only the partitions in the data are overwritten."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[p for p in partition if p in df.columns]).parquet(f"{path}/{name}")


def shards(items: DataFrame, keys: list[str], order: list[str], size: int = SHARD_ITEMS) -> DataFrame:
    """items with `shard`: runs of `size` items of each key in the order."""
    return chunks(items, keys, order, size, "shard")


def route(projects: DataFrame, category: str, project: str, seed: int = 42, holdout: float = 0.5) -> DataFrame:
    """projects with `route`: the category, and of the successes a seeded share apart as holdout."""
    held = (F.col(category) == "success") & (hash_share(F.col(project), seed) < holdout)
    return projects.withColumn("route", F.when(held, "holdout").otherwise(F.col(category)))


def safe_name(name: Column) -> Column:
    """A name that can be a file's: everything but letters, digits, dot, dash and underscore replaced."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def node_color(flagged: Column, node_type: Column) -> Column:
    return F.when(flagged, "red").when(node_type == "cfg_node", "lightblue").otherwise("lightgreen")


def edge_color(sub_type: Column, edge_type: Column) -> Column:
    kind = F.coalesce(F.nullif(sub_type, F.lit("")), edge_type)
    return F.when(kind.isin("cf_true"), "green").when(kind.isin("cf_false"), "red").when(kind.isin("call", "return_call"), "blue").when(kind == "df", "orange").when(kind == "ast_child", "gray").otherwise("black")


def dot_lines(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, part, line: the lines of a DOT text per key. nodes: key, node_id, label; edges: key, src, dst, label.

    A text is written by sorting on (key, part, line); no text is put together in one row.
    """
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    keys = nodes.select(key).distinct()
    head = keys.select(key, F.lit(0).alias("part"), F.lit("digraph G {").alias("line"))
    n = nodes.select(key, F.lit(1).alias("part"), F.concat(quote(F.col("node_id")), F.lit(" [label="), quote(F.col("label")), F.lit("];")).alias("line"))
    e = edges.select(key, F.lit(2).alias("part"), F.concat(quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [label="), quote(F.col("label")), F.lit("];")).alias("line"))
    foot = keys.select(key, F.lit(3).alias("part"), F.lit("}").alias("line"))
    return head.unionByName(n).unionByName(e).unionByName(foot)


def ir_dot_rows(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the instructions of IR entries (file, ..., ord, instrs), ready for dot_lines with key `file`."""
    i = entries.select("file", "contract", "function", "ord", F.explode("instrs").alias("x"))
    name = F.concat_ws("/", "contract", "function", "ord", F.col("x.idx").cast("string"))
    var = lambda v: F.concat_ws("/", "contract", "function", v)
    uses = i.select("file", name.alias("dst"), F.explode("x.uses").alias("v"), "contract", "function").select("file", var("v").alias("src"), "dst", F.lit("data").alias("label"))
    defs = i.select("file", name.alias("src"), F.explode("x.defs").alias("v"), "contract", "function").select("file", "src", var("v").alias("dst"), F.lit("assign").alias("label"))
    edges = uses.unionByName(defs)
    instrs = i.select("file", name.alias("node_id"), F.concat_ws(" ", "x.kind", "x.raw").alias("label"))
    names = uses.select("file", F.col("src").alias("node_id")).unionByName(defs.select("file", F.col("dst").alias("node_id"))).distinct()
    return instrs.unionByName(names.withColumn("label", F.element_at(F.split("node_id", "/"), -1))), edges


def build_summary(nodes: DataFrame, edges: DataFrame, finding_nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """project, metric, value: counts of nodes, edges, findings and matched nodes per project, in long form."""
    parts = [
        nodes.groupBy("project", F.concat(F.col("node_type"), F.lit("_node_count")).alias("metric")).agg(F.count("*").alias("value")),
        edges.groupBy("project", F.concat(F.col("edge_type"), F.lit("_edge_count")).alias("metric")).agg(F.count("*").alias("value")),
        findings.groupBy("project").agg(F.count("*").alias("value")).withColumn("metric", F.lit("vuln_entry_count")),
        finding_nodes.groupBy("project").agg(F.count_distinct("node_id").alias("value")).withColumn("metric", F.lit("vuln_matched_node_count")),
    ]
    out = parts[0].select("project", "metric", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select("project", "metric", "value"))
    return out


def merged_metadata(old: DataFrame, new: DataFrame, key: str = "address") -> DataFrame:
    """Rows of both, one per key: the old one where there is one."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [key], ["_age"]).drop("_age")


def append_ledger(entries: DataFrame, path: str) -> None:
    """Step entries (project, file, step, status, error, updated_at), appended; an error is kept only with status -1."""
    entries.withColumn("error", F.when(F.col("status") == -1, F.col("error"))).write.mode("append").parquet(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """stage, model and their mean metrics and minutes, by stage and model."""
    return runs.groupBy("stage", "model").agg(F.avg("f1").alias("f1"), F.avg("auc").alias("auc"), F.avg("hamming").alias("hamming"), (F.sum("seconds") / 60).alias("minutes"), F.max("parameters").alias("parameters")).orderBy("stage", "model")


def shares(counts: DataFrame, value: str = "n") -> DataFrame:
    """counts with `percent` of their sum, 2 decimals."""
    return counts.withColumn("percent", F.round(100 * F.col(value) / F.sum(value).over(W.partitionBy()), 2))
