"""Mixing sources to target weights by weighted fair queueing, on DataFrame operations alone.

Every source is a flow whose documents arrive in shuffled order (by md5 of the doc_id), again and
again up to max_repeats times. A document's virtual finish time is its source's tokens so far,
itself included, divided by the source's target. Served in the order of finish times up to the
total budget, each source comes within about a document of its target.

Running sums are taken in two levels: sums of ranges of the order, then sums inside a range, so a
source with most of the rows is still spread over many tasks. The cut at the budget is found the
same way: sums of ranges of finish time first, and a global order only inside the range cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tables import written

#: rows that a range of the shuffled order holds on average
ROWS_PER_RANGE = 2048
#: ranges of finish time in each of the two levels of the cut
CUT_RANGES = 1024


def word_count(text: str) -> F.Column:
    """Runs of characters other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[float, ...], most: float, share: float) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Sources by code point, null last, take the weights of cycle in turn and share `share` of all
    sizes; a target stops at `most` times its source's size and the excess is shared by weight
    among the others. That is one water level: sorted by cap / weight, the sources below the level
    are at their caps. The input is one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
    capped = weighted.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    levels = capped.withColumn("level", (share * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the level is that of the first source in the order whose cap isn't below it; later ones' are lower
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy())
    return levels.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(level, F.max("ratio").over(W.partitionBy()))).alias("target"))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, one row for each row of docs.

    docs: doc_id, text, source. Null texts and texts without words have size 0 and are never
    taken; null sources are one source, last in the order. Rows that repeat a doc_id count each,
    in the order of their sizes. An empty table gives an empty result.
    """
    order = ["h", "doc_id", "size"]
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    sized = written(sized.withColumn("u", F.conv(F.substring("h", 1, 8), 16, 10).cast("long")), "sizes")
    rows = sized.count()
    ranges = 1 << max(0, -(-rows // ROWS_PER_RANGE) - 1).bit_length()
    wide = (1 << 32) // ranges
    sized = sized.withColumn("part", F.floor(F.col("u") / wide))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    by_part = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = parts.select("source", "part", F.coalesce(F.sum("part_size").over(by_part), F.lit(0)).alias("ahead"))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, float(max_repeats), share)
    inside = W.partitionBy("source", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = (
        sized.withColumn("sum_in_part", F.sum("size").over(inside))
        .join(ahead.withColumnRenamed("source", "s2").withColumnRenamed("part", "p2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
        .drop("s2", "p2")
        .join(goal.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")))
        .drop("s3")
        .withColumn("so_far", F.col("ahead") + F.col("sum_in_part"))
    )
    placed = written(placed.select("doc_id", "source", "h", "size", "source_size", "target", "so_far"), "queue")
    key = F.struct("finish", F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), "position")
    copies = (
        placed.where("size > 0 AND target > 0")
        .withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(max_repeats)])))
        .withColumn("position", F.col("pass") * F.col("source_size") + F.col("so_far"))
        .withColumn("finish", F.col("position") / F.col("target"))
        .withColumn("r1", F.floor(F.col("finish") * CUT_RANGES))
        .withColumn("r2", F.floor((F.col("finish") * CUT_RANGES - F.col("r1")) * CUT_RANGES))
    )
    # whole words: the order in which doubles are summed must not move the cut
    budget = goal.agg(F.round(F.sum("target")).alias("budget"))
    # the range where the sum passes the budget, then the range inside it, then the first copy past it
    one = copies.groupBy("r1").agg(F.sum("size").alias("s")).withColumn("e", F.sum("s").over(W.orderBy("r1"))).crossJoin(F.broadcast(budget)).where("e > budget")
    one = one.agg(F.min("r1").alias("c1"), F.min(F.col("e") - F.col("s")).alias("ahead1"), F.first("budget").alias("budget"))
    two = copies.join(F.broadcast(one), F.col("r1") == F.col("c1")).groupBy("r2").agg(F.sum("size").alias("s"), F.first("c1").alias("c1"), F.first("ahead1").alias("ahead1"), F.first("budget").alias("budget"))
    two = two.withColumn("e", F.col("ahead1") + F.sum("s").over(W.orderBy("r2"))).where("e > budget")
    two = two.agg(F.first("c1").alias("c1"), F.min("r2").alias("c2"), F.min(F.col("e") - F.col("s")).alias("ahead2"), F.first("budget").alias("budget"))
    edge = copies.join(F.broadcast(two), (F.col("r1") == F.col("c1")) & (F.col("r2") == F.col("c2"))).withColumn("key", key)
    cut = edge.withColumn("total", F.col("ahead2") + F.sum("size").over(W.orderBy("key"))).where("total > budget").agg(F.min("key").alias("cut"))
    passes = F.lit(0)
    for k in range(max_repeats):
        position = k * F.col("source_size") + F.col("so_far")
        mine = F.struct((position / F.col("target")).alias("finish"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), position.alias("position"))
        passes = passes + F.when(F.col("cut").isNull() | (mine < F.col("cut")), 1).otherwise(0)
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), passes * F.col("size")).otherwise(0)
    return placed.crossJoin(F.broadcast(cut)).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
