"""Readers of the raw inputs: syntax trees, control-flow texts, intermediate code, findings, logs, tables.

All read whole folders as one DataFrame; unreadable files become rows without content or are left
out, and never stop a job. Orders that folders don't have are by file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.graph_text import DotRows, TreeRows, cfg_label
from tessera.functions.ir import parse_ir
from tessera.functions.vocabulary import LOG_FINDINGS
from tessera.operators.ordered import carry_context


def _basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def texts(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """path, file, text of every file of the folder that fits the glob."""
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), _basename(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def syntax_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all trees: unit, node_no, parent_no, depth, node_type, label, file, contract, function, args, src, ml.

    Of units of one name the one of the last file, by name, holds.
    """
    files = texts(spark, path, "*.json")
    spark.udtf.register("tree_rows", TreeRows)
    files.createOrReplaceTempView("_tree_files")
    nodes = spark.sql("SELECT f.path AS unit, t.* FROM _tree_files f, LATERAL tree_rows(f.text) t")
    last = nodes.where("parent_no IS NULL").groupBy("label").agg(F.max("unit").alias("_last")).select(F.col("_last").alias("unit")).distinct()
    return nodes.join(last, "unit", "left_semi")


def control_flow(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all DOT files of a folder. The file name is `file-contract-function.dot`."""
    spark.udtf.register("dot_rows", DotRows)
    texts(spark, path, "*.dot", recursive=False).createOrReplaceTempView("_dot_files")
    rows = spark.sql("SELECT f.file AS dot, d.* FROM _dot_files f, LATERAL dot_rows(f.text) d")
    parts = F.split(F.regexp_replace("dot", r"\.dot$", ""), "-")
    rows = rows.select(parts[0].alias("file"), F.try_element_at(parts, F.lit(2)).alias("contract"), F.array_join(F.slice(parts, 3, 1000), "-").alias("function"), "dot", "kind", "name", "dst", "label")
    nodes = rows.where("kind = 'node'").groupBy("file", "contract", "function", "dot", "name").agg(F.max("label").alias("label"))
    nodes = nodes.select("*", *[c.alias(n) for n, c in cfg_label(F.col("label")).items()])
    edges = rows.where("kind = 'edge'").select("file", "contract", "function", "dot", F.col("name").alias("src_raw"), F.col("dst").alias("dst_raw"), "label")
    return nodes, edges


def intermediate_code(spark: SparkSession, path: str) -> DataFrame:
    """file, contract, function, args, ord, expr_md5, expression, ir, instrs: one row per expression.

    The lines of all printers are one ordered table; contract, function and expression are carried
    down by windows per file. Repeated functions and entries keep their first place.
    """
    files = texts(spark, path, "*.json")
    printed = F.from_json("text", "results struct<printers: array<struct<description: string>>>").getField("results").getField("printers")
    lines = files.select("file", F.posexplode(printed).alias("printer", "p")).select("file", "printer", F.posexplode(F.split("p.description", "\n")).alias("no", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("line <> ''")
    pick = lambda pattern, group=1: F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))
    head, entry = F.col("line").rlike(r"^(Function|Modifier)\s+\S"), F.col("line").rlike(r"(?i)^ENTRY_POINT(\s|$)")
    signature = F.when(head, F.regexp_extract("line", r"^(?:Function|Modifier)\s+(?:[^.]+\.)?(.+)$", 1)).when(entry, F.coalesce(pick(r"(?i)^ENTRY_POINT\s+(.*)$"), F.lit("ENTRY_POINT")))
    is_expression = F.col("line").rlike(r"^(Expression|EXPRESSION)")
    key, order = ["file", "printer"], ["no"]
    out = carry_context(lines, key, order, pick(r"^Contract\s+([A-Za-z0-9_]+)"), "block_contract")
    out = carry_context(out, key, order, F.when(head, F.coalesce("block_contract", pick(r"^(?:Function|Modifier)\s+([^.]+)\."))), "contract")
    out = carry_context(out, key, order, signature, "signature")
    out = carry_context(out, key, order, F.when(signature.isNotNull() | F.col("line").rlike(r"^Contract\s"), F.col("no")), "block")
    out = carry_context(out, [*key, "block"], order, F.when(is_expression, F.col("no")), "at")
    said = out.where("signature IS NOT NULL AND at IS NOT NULL")
    body = F.when(~is_expression & ~F.col("line").rlike("^(Function|IRs:)"), F.struct("no", "line"))
    grouped = said.groupBy(*key, "contract", "signature", "block", "at").agg(
        F.max(F.when(is_expression, F.trim(F.regexp_extract("line", r"^(?:Expression|EXPRESSION)\s*:?(.*)$", 1)))).alias("expression"), F.array_sort(F.collect_list(body)).alias("body")
    )
    entries = grouped.where("expression <> ''").withColumn("ir", F.array_join("body.line", "\n"))
    entries = entries.withColumn("function", F.trim(F.regexp_extract("signature", r"^([^(]+)", 1))).withColumn("args", F.regexp_extract("signature", r"\((.*)\)", 1))
    function = ["file", "contract", "function", "args"]
    first_block = F.min(F.struct("printer", "block")).over(W.partitionBy(*function)) == F.struct("printer", "block")
    entries = entries.withColumn("_first", first_block).where("_first")
    entries = entries.withColumn("_n", F.row_number().over(W.partitionBy(*function, "expression", "ir").orderBy("at"))).where("_n = 1")
    numbered = entries.withColumn("ord", F.row_number().over(W.partitionBy(*function).orderBy("at")) - 1)
    clean = F.regexp_replace(F.regexp_replace("file", "^ir_", ""), r"\.json$", "")
    return numbered.select(clean.alias("file"), "contract", "function", F.concat(F.lit("("), "args", F.lit(")")).alias("args"), "ord", F.md5("expression").alias("expr_md5"), "expression", "ir").withColumn("instrs", parse_ir("ir"))


_FINDING_A = "filePath string, sourcePath string, SWCs array<struct<category: string, function: string, lineNumber: string, lines: string>>"
_FINDING_B = "map<string, map<string, array<struct<name: string, line: int, line_end: int, function: string, filename: string, contract: string>>>>"
_FINDING_C = "array<struct<name: string, vulnerabilities: array<struct<lines: array<int>, category: string>>>>"


def findings_by_file(spark: SparkSession, path: str, detect_type: str) -> DataFrame:
    """Form A: project, file, function, category, lines, detect_type, one row per finding."""
    read = texts(spark, path, "*.json").withColumn("x", F.from_json("text", _FINDING_A, {"mode": "PERMISSIVE"}))
    return read.select(F.regexp_replace("file", r"\.json$", "").alias("project"), F.coalesce("x.filePath", "x.sourcePath").alias("file"), F.explode("x.SWCs").alias("s")).select("project", "file", "s.function", "s.category", F.coalesce("s.lineNumber", "s.lines").alias("lines"), F.lit(detect_type).alias("detect_type"))


def findings_by_tool(spark: SparkSession, path: str) -> DataFrame:
    """Form B: file, tool, name, function, contract, line, line_end."""
    read = texts(spark, path, "*.json").select(F.explode(F.from_json("text", _FINDING_B)).alias("file", "tools"))
    return read.select("file", F.explode("tools").alias("tool", "list")).select("file", "tool", F.explode("list").alias("f")).select("file", "tool", "f.name", "f.function", "f.contract", "f.line", "f.line_end")


def findings_by_category(spark: SparkSession, paths: dict[str, str | None], categories: list[str], names: DataFrame | None = None) -> DataFrame:
    """Form C, compiled: name, category, lines of label files.

    paths: file -> the category all its rows have, or None where each row names one of `categories`.
    names: category_name, unknown_name, hash_name; a file's name is looked up under the first two.
    """
    parts = []
    for path, implied in paths.items():
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _FINDING_C)).alias("f")).select("f.name", F.explode("f.vulnerabilities").alias("v"))
        parts.append(rows.select("name", F.lit(implied).alias("category") if implied else F.col("v.category").alias("category"), "v.lines").where(F.lit(implied is not None) | F.col("category").isin(categories)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    if names is not None:
        by = lambda c: F.broadcast(names.select(F.col(c).alias("name"), F.col("hash_name").alias(f"_{c}")).dropDuplicates(["name"]))
        union = union.join(by("category_name"), "name", "left").join(by("unknown_name"), "name", "left").withColumn("name", F.coalesce("_category_name", "_unknown_name", "name"))
    return union.select("name", "category", F.explode("lines").alias("line")).groupBy("name", "category").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """code, category of a `swc_id, owasp_id, check` table, without the rows checked x."""
    t = spark.read.csv(path, header=True)
    return t.where(F.lower(F.trim(F.coalesce("check", F.lit("")))) != "x").select(F.upper(F.trim("swc_id")).alias("code"), F.upper(F.trim("owasp_id")).alias("category"))


def detector_map(spark: SparkSession, path: str) -> DataFrame:
    """detector, category of a detector table; missing categories are N/A, malformed lines left out."""
    t = spark.read.csv(path, header=True, mode="DROPMALFORMED").toDF("detector", "category")
    return t.select(F.trim("detector").alias("detector"), F.coalesce(F.trim("category"), F.lit("N/A")).alias("category"))


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """address, tx_count, largest first; counts that can't be read, or aren't there, are 0. Only 0x and 40 hex digits pass."""
    t = spark.read.csv(path, header=True)
    count = F.coalesce(F.trim(F.col(t.columns[1])).try_cast("bigint"), F.lit(0)) if len(t.columns) > 1 else F.lit(0)
    return t.select(F.trim(F.col(t.columns[0])).alias("address"), count.cast("long").alias("tx_count")).where(F.col("address").rlike("^0x[0-9a-fA-F]{40}$")).orderBy(F.desc("tx_count"), "address")


def contracts(spark: SparkSession, metadata: str, required: tuple[str, ...] = ("address", "file_path")) -> DataFrame:
    """Contract metadata with `pragma_group` (0.8.x) from the pragma, else the compiler version, else unknown."""
    t = spark.read.csv(metadata, header=True)
    if missing := [c for c in required if c not in t.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    optional = lambda c: F.col(c) if c in t.columns else F.lit(None).cast("string")
    group = lambda c: F.nullif(F.regexp_extract(c, r"([0-9]+\.[0-9]+)\.[0-9]+", 1), F.lit(""))
    found = F.coalesce(group(optional("pragma")), group(optional("compiler_version")))
    return t.withColumn("pragma_group", F.coalesce(F.concat(found, F.lit(".x")), F.lit("unknown")))


def analyser_logs(spark: SparkSession, path: str, names: tuple[str, ...] = tuple(LOG_FINDINGS)) -> DataFrame:
    """path, filename, line, name, snippet of in-scope warnings of every result.log below the folder."""
    logs = texts(spark, path, "result.log").select("path", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    pattern = r"^(?:INFO:symExec:)?(/.+\.sol):([0-9]+):([0-9]+): Warning: (.*?)\."
    w = W.partitionBy("path").orderBy("no")
    after = F.lead("raw").over(w)
    rows = logs.withColumn("after", after).where(F.col("raw").rlike(pattern))
    part = lambda g: F.regexp_extract("raw", pattern, g)
    out = rows.select("path", part(1).alias("filename"), part(2).cast("int").alias("line"), part(4).alias("name"), F.when(F.col("after").rlike(r"^\s+\S"), F.trim("after")).alias("snippet"))
    return out.where(F.col("name").isin(*names))


def source_folders(spark: SparkSession, path: str, max_depth: int = 7) -> DataFrame:
    """folder of every folder with .sol files, down to a depth, node_modules left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sol").option("recursiveFileLookup", "true").load(path).select("path")
    below = F.regexp_replace("path", "^.*" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.withColumn("below", below).where((F.size(F.split("below", "/")) <= max_depth + 1) & ~F.col("path").contains("/node_modules/")).select(F.regexp_replace("path", "/[^/]+$", "").alias("folder")).distinct()


def compiler_output(df: DataFrame, text: str) -> DataFrame:
    """df's rows split at `======= file =======` lines: source, content."""
    part = F.explode(F.slice(F.split(text, r"(?m)^=======\s*"), 2, 2147483647))
    return df.withColumn("_part", part).select(*[c for c in df.columns if c != text], F.trim(F.regexp_extract("_part", r"^(.*?)\s*=======", 1)).alias("source"), F.regexp_replace(F.regexp_replace("_part", r"^.*?=======\s*", ""), r"\s+$", "").alias("content"))


def package_versions(spark: SparkSession, path: str) -> DataFrame:
    """package, version of every package.json below a folder."""
    return texts(spark, path, "package.json").select(F.get_json_object("text", "$.name").alias("package"), F.get_json_object("text", "$.version").alias("version"))


def weight_names(names: DataFrame, name: str) -> DataFrame:
    """names with layer, relation and part of saved weights called `layers.N.RELATION.PART...`."""
    parts = F.split(name, "\\.")
    return names.select("*", F.try_element_at(parts, F.lit(2)).try_cast("int").alias("layer"), F.try_element_at(parts, F.lit(3)).alias("relation"), F.array_join(F.slice(parts, 4, 1000), ".").alias("part"))
