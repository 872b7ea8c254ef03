"""One query opN_<name> for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunks, decontamination, html, lines, mixing, near_duplicates, neighbours, quality, sql, toxicity, urls

#: scores from which on a document is predicted to have label 1
TOXIC_FROM = GOOD_FROM = 0.3
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(of: int, held: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == held, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, toxicity.training_labels(labels, "toxic", 4, 2, held=False))
    scored = toxicity.toxicity(docs, index)
    return scored.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "neighbours", "cosines")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the page of `/language/number` shows the document of that number, and is bad where its quality label is 0."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint)").alias("doc_id"))
    outcomes = shown.join(labels.where("quality IN (0, 1)").groupBy("doc_id").agg((1 - F.max("quality")).alias("bad")), "doc_id")
    # a page_id that repeats counts once for each of its rows
    outcomes = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    return urls.judge(pages, outcomes, URL_RULES)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = lines.repeated_runs(table(spark, sf_dir, "documents"))
    return runs.select("doc_id", "first_line", "last_line", "n_words", "source_doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, toxicity.training_labels(labels, "quality", 5, 0, held=False))
    scored = quality.quality(docs, weights)
    return scored.select("doc_id", _fold(5, 0).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_near_duplicates, op3_mixing, op4_url_filter, op5_repeated_passages, op6_nearest_vectors, op7_decontamination, op8_repeated_lines, op9_quality, op10_main_text)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.BY_QUERY)
