"""The corpus pipeline: toxicity, repeated lines, near duplicates, benchmark passages, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, lines, mixing, near_duplicates, registry, toxicity
from tessera.llm.tables import drop, written


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the labelled examples score as toxic; nothing else about a document counts."""
    index = toxicity.fit(docs, toxicity.training_labels(registry.table(spark, sf_dir, "labels"), "toxic", 4, 2, held=False))
    return toxicity.keep_clean(docs, index, registry.TOXIC_FROM)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeats of runs of lines out of the texts; a document that is nothing else goes."""
    return lines.drop_repeated_runs(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates."""
    gone = near_duplicates.near_duplicate_groups(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a document that is mostly such passages goes."""
    return decontamination.decontaminate(docs, registry.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL can't express the first stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next one stands."""
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(docs)
        docs = done
    return docs
