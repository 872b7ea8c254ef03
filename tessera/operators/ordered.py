"""Operators over ordered rows: carried context, islands, as-of matches, balanced scans, ranks.

Each takes its key and order columns by name; orders must be total, ties are the caller's to break.
Every key is a window partition, so state never crosses keys and keys run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_context(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, default: Column | None = None) -> DataFrame:
    """The last non-null value at or before each row, or the default."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    carried = F.last(value, ignorenulls=True).over(w)
    return df.withColumn(out, carried if default is None else F.coalesce(carried, default))


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, range_from, range_to of runs of consecutive whole numbers; repeats count once."""
    distinct = df.select(*keys, value).distinct()
    run = F.col(value) - F.row_number().over(W.partitionBy(*keys).orderBy(value))
    return distinct.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(value).alias("range_from"), F.max(value).alias("range_to")).drop("_run")


def asof_backward(df: DataFrame, keys: list[str], order: str, is_left: Column, is_right: Column, right_value: Column, out: str) -> DataFrame:
    """Rows of is_left with the value of the latest earlier row of is_right; one sort, no range join."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_l", is_left).withColumn(out, F.last(F.when(is_right, right_value), ignorenulls=True).over(w)).where("_l").drop("_l")


def asof_forward_then_back(df: DataFrame, keys: list[str], order: str, is_left: Column, is_right: Column, right_value: Column, out: str) -> DataFrame:
    """As asof_backward, but the next match after the row comes first."""
    value = F.when(is_right, right_value)
    back = F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ahead = F.first(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(1, W.unboundedFollowing))
    return df.withColumn("_l", is_left).withColumn(out, F.coalesce(ahead, back)).where("_l").drop("_l")


def near_marker(df: DataFrame, keys: list[str], order: str, marker: Column, rows: int, out: str) -> DataFrame:
    """Whether a row of the marker stands within so many rows before or after."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-rows, rows)
    return df.withColumn(out, F.max(marker.cast("int")).over(w) == 1)


def interval_text(lines: DataFrame, spans: DataFrame, key: str, line: str, text: str, first: str, last: str) -> DataFrame:
    """spans with the lines first..last (1-based, inclusive) of their key, joined by line feeds."""
    hit = spans.join(lines, key).where(F.col(line).between(F.col(first), F.col(last)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, text))), lambda x: x[text]), "\n")
    return hit.groupBy(*spans.columns).agg(joined.alias("snippet"))


def balanced_scan(df: DataFrame, keys: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """keys, opened_at, closed_at: from the first opener to where the depth first returns to zero.

    What stands before the first opener does not count; closed_at is null if the depth never returns.
    """
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    w = W.partitionBy(*keys).orderBy(order)
    opened = F.max(opens.cast("int")).over(w) == 1
    inside = df.withColumn("_step", F.when(opened, step).otherwise(0)).withColumn("_open", opened)
    depth = inside.withColumn("_depth", F.sum("_step").over(w)).where("_open")
    return depth.groupBy(*keys).agg(F.min(order).alias("opened_at"), F.min(F.when(F.col("_depth") == 0, F.col(order))).alias("closed_at"))


def dense_ids(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rank of the value among the sorted distinct values of its key, from 0."""
    return df.withColumn(out, F.dense_rank().over(W.partitionBy(*keys).orderBy(value)) - 1)


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], keep: Column, n: int) -> DataFrame:
    """All rows of keep, and the first n of the others of each key."""
    rank = F.row_number().over(W.partitionBy(*keys, keep).orderBy(*order))
    return df.withColumn("_n", rank).where(keep | (F.col("_n") <= n)).drop("_n")


def resume_after(df: DataFrame, order: list[str], done: Column) -> DataFrame:
    """Rows after the last done one in the order; all of them if none is done.

    The pointer is one aggregate of the largest done key, so no global ranking is needed.
    """
    key = F.struct(*order)
    last = df.where(done).agg(F.max(key).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (key > F.col("_last"))).drop("_last")


def chunks(df: DataFrame, keys: list[str], order: list[Column | str], size: int, out: str, most: int | None = None) -> DataFrame:
    """Number of the chunk of `size` rows of each key, from 0; chunks from `most` on are dropped."""
    numbered = df.withColumn(out, F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))
    return numbered if most is None else numbered.where(F.col(out) < most)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def running_best(df: DataFrame, keys: list[str], order: str, score: str, loss: str, patience: int) -> DataFrame:
    """Per row: best score so far, whether it improves on all before, and epochs since the least loss; stop at patience."""
    w = W.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("best_score", F.max(score).over(w)).withColumn("improved", F.coalesce(F.col(score) > F.max(score).over(before), F.lit(True)))
    out = out.withColumn("_n", F.row_number().over(w)).withColumn("_less", F.coalesce(F.col(loss) < F.min(loss).over(before), F.lit(True)))
    out = out.withColumn("waited", F.col("_n") - F.max(F.when(F.col("_less"), F.col("_n"))).over(w))
    return out.withColumn("stopped", F.max((F.col("waited") >= patience).cast("int")).over(w) == 1).drop("_n", "_less")
