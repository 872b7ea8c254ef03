"""Joins that link program elements: calls, returns, definitions and uses, visible names, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_calls(sites: DataFrame, definitions: DataFrame, site: list[str], on: list[str], site_args: str, args: str) -> DataFrame:
    """Sites joined to definitions of the same name; where some have the site's arguments, only those."""
    joined = sites.join(definitions, on).withColumn("exact", F.coalesce(F.col(site_args) == F.col(args), F.lit(False)))
    any_exact = F.max(F.col("exact").cast("int")).over(W.partitionBy(*site)) == 1
    return joined.withColumn("_any", any_exact).where(F.col("exact") | ~F.col("_any")).drop("_any")


def return_edges(calls: DataFrame, returns: DataFrame, flow: DataFrame, target: str, site: str) -> DataFrame:
    """src, dst: from each return node of a call's target to each successor of the call site."""
    after = flow.select(F.col("src").alias(site), F.col("dst").alias("_next"))
    return calls.join(returns.select(target, F.col("node").alias("_ret")), target).join(after, site).select(F.col("_ret").alias("src"), F.col("_next").alias("dst")).distinct()


def def_use(defs: DataFrame, uses: DataFrame, keys: list[str], position: str, node: str) -> DataFrame:
    """keys, def, use: every use with all earlier definitions of its key (no kill), itself left out."""
    d = defs.select(*keys, F.col(position).alias("_dp"), F.col(node).alias("def"))
    u = uses.select(*keys, F.col(position).alias("_up"), F.col(node).alias("use"))
    # the keys keep this an equi-join; the order of positions is its residual condition
    return d.join(u, keys).where("_dp < _up AND def <> use").select(*keys, "def", "use").distinct()


def reaching_counts(events: DataFrame, keys: list[str], order: list[str], is_def: Column) -> DataFrame:
    """As def_use where only the number of reaching definitions is wanted: one window, no pairs."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("reaching", F.coalesce(F.sum(is_def.cast("long")).over(w), F.lit(0)))


def first_by_priority(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of the parts; for each key the row of the earliest part, in it the first of the order."""
    tagged = [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    return union.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("priority", *order))).where("_n = 1").drop("_n")


def prefix_join(rows: DataFrame, prefixes: DataFrame, text: str, prefix: str, lengths: tuple[int, ...]) -> DataFrame:
    """rows with the longest prefix of their text; an equi-join on each possible length.

    lengths are the lengths that occur among the prefixes, a bounded vocabulary.
    """
    cut = F.explode(F.array(*[F.substring(text, 1, n) for n in sorted(set(lengths))]))
    key = [c for c in rows.columns]
    hit = rows.withColumn(prefix, cut).join(prefixes, prefix)
    w = W.partitionBy(*key).orderBy(F.length(prefix).desc())
    return hit.where(F.col(text).startswith(F.col(prefix))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def contains_matches(texts: DataFrame, needles: DataFrame, text: str, needle: str, words: int = 4) -> DataFrame:
    """Rows of texts with the needles they contain, found by an equi-join.

    Each needle is looked up under its rarest run of `words` whole words and confirmed by
    `contains`; needles of fewer than words + 2 words, whose ends may be cut, are few by the
    caller's choice and are tried on every text (broadcast only where Spark knows them to be small).
    """
    split = lambda c: F.split(F.col(c), " ")
    # runs by zipping the words with themselves, shifted: each word array is made once per shift
    shifted = [F.slice(split(text), F.lit(k + 1), F.greatest(F.size(split(text)) - words + 1, F.lit(0))) for k in range(words)]
    runs = F.transform(F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)]), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(words)]))
    long = F.size(split(needle)) >= words + 2
    # the first run that doesn't touch the needle's first word, which may be the end of a longer one
    probe = needles.where(long).withColumn("_k", F.array_join(F.slice(split(needle), 2, words), " "))
    found = texts.where(F.size(split(text)) >= words).withColumn("_k", F.explode(F.array_distinct(runs))).join(probe, "_k").drop("_k")
    rest = texts.crossJoin(needles.where(~long))
    return found.unionByName(rest).where(F.col(text).contains(F.col(needle))).distinct()


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of left that right has not: the set difference as an anti-join."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
