"""Labels: taxonomies, bubble-up, multi-hot vectors, outcome classes, splits and re-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def map_taxonomy(findings: DataFrame, taxonomy: DataFrame, code: str, category: str, required: bool, default: str = "N/A") -> DataFrame:
    """findings with their category. Unmapped ones are dropped if required, else get the default.

    The taxonomy is a vocabulary of codes and is broadcast.
    """
    hit = findings.join(F.broadcast(taxonomy.select(code, category)), code, "inner" if required else "left")
    return hit if required else hit.withColumn(category, F.coalesce(category, F.lit(default)))


def distribution(df: DataFrame, key: str, top: int) -> DataFrame:
    """key, n, percent (of all rows, 2 decimals) of the most frequent keys, ties by key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("_total"), 2)).orderBy(F.desc("n"), key).limit(top).drop("_total")


def top_with_others(df: DataFrame, key: str, top: int, others: str = "Others") -> DataFrame:
    """key, n of the most frequent keys, and the remainder as one row."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), key).limit(top)
    rest = counts.join(best, key, "left_anti").agg(F.lit(others).alias(key), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.unionByName(rest)


def bubble_up(leaves: DataFrame, flag: Column, levels: list[str]) -> dict[str, DataFrame]:
    """For each level (innermost first) one row per key with `label`: whether any row below has the flag.

    Each level is made from the one below it, so rows shrink before every shuffle.
    """
    out: dict[str, DataFrame] = {}
    below = leaves.withColumn("label", F.coalesce(flag.cast("int"), F.lit(0)))
    for i, level in enumerate(levels):
        keys = levels[i:]
        below = below.groupBy(*keys).agg(F.max("label").alias("label"))
        out[level] = below
    return out


def multi_hot(df: DataFrame, keys: list[str], category: str, domain: list[str], prefix: str = "c") -> DataFrame:
    """One column of 0.0 or 1.0 per category of the domain; categories outside the domain count nothing."""
    return df.groupBy(*keys).agg(*[F.max(F.coalesce((F.col(category) == c).cast("double"), F.lit(0.0))).alias(f"{prefix}{i}") for i, c in enumerate(domain)])


def one_hot(value: Column, domain: list[str]) -> list[Column]:
    """1.0 where the lower-cased value is the domain's; all 0.0 for what the domain has not."""
    return [F.when(F.lower(value) == d, 1.0).otherwise(0.0) for d in domain]


def outcome(has_graph: Column, has_tree: Column, matches: Column) -> Column:
    """success with both graphs and a match; failed if a graph is missing; else benign."""
    return F.when(has_graph.isNull() | has_tree.isNull() | ~has_graph | ~has_tree, "failed").when(matches > 0, "success").otherwise("benign")


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def stratified_split(df: DataFrame, label: str, key: str, seed: int, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """df with `split`. Each label's rows are ranked by a seeded hash; a label of three rows or more has a row in each part."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    n = F.count("*").over(W.partitionBy(label))
    rank = F.row_number().over(W.partitionBy(label).orderBy(order, key))
    ranked = df.withColumn("_n", n).withColumn("_r", rank)
    least = F.when(F.col("_n") >= 3, 1).otherwise(0)
    n_val = F.greatest(F.floor(F.col("_n") * validation), least)
    n_test = F.greatest(F.col("_n") - F.floor(F.col("_n") * train) - n_val, least)
    n_train = F.col("_n") - n_val - n_test
    return ranked.withColumn("split", F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "validation").otherwise("test")).drop("_n", "_r")


def oversample(df: DataFrame, chosen: Column, ratio: float, copy: str = "copy") -> DataFrame:
    """Rows of chosen int(ratio - 1) more times, numbered by `copy` from 0."""
    more = max(0, int(ratio - 1))
    return df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.when(chosen, more).otherwise(0))))


def undersample(df: DataFrame, thinned: Column, ratio: float, key: list[str], seed: int) -> DataFrame:
    """Rows outside `thinned`, and the share `ratio` (rounded down) of the others by seeded hash order."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    w = W.partitionBy("_thin")
    out = df.withColumn("_thin", thinned).withColumn("_r", F.row_number().over(w.orderBy(order, *key))).withColumn("_n", F.count("*").over(w))
    return out.where(~F.col("_thin") | (F.col("_r") <= F.floor(F.col("_n") * ratio))).drop("_thin", "_r", "_n")


def class_weights(df: DataFrame, labels: list[str], low: float = 1.0, high: float = 10.0) -> DataFrame:
    """class, pos, neg, weight: negatives over positives, kept within [low, high]."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("int").alias("y")) for c in labels])).alias("x"))
    counts = rows.groupBy(F.col("x.class").alias("class")).agg(F.sum("x.y").alias("pos"), F.sum(1 - F.col("x.y")).alias("neg"))
    return counts.withColumn("weight", F.round(F.least(F.greatest(F.col("neg") / F.greatest(F.col("pos"), F.lit(1)), F.lit(low)), F.lit(high)), 6))


def contract_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations: rows of the whole table that break each rule, in one pass."""
    sums = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("x")).select("x.*")
