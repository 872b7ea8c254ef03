"""Connected components of a link table, without gathering links anywhere.

Each partition first reduces its links to a spanning forest by union-find; then large-star and
small-star rounds turn the forest into stars around the smallest vertex of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import drop, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition -> (vertex, root); flushed when many vertices are held."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    def out() -> pa.RecordBatch:
        rows = [(v, root(v)) for v in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["v", "u"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield out()
    yield out()


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round: links (v, u) with v > u."""
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = near.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    joined = near.join(least, "v")
    if small:
        # every smaller neighbour, and the vertex itself, to the least neighbour
        moved = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
    else:
        # every larger neighbour to the least one
        moved = joined.where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.where("v <> u").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(v, component): each vertex that has a link, and the smallest vertex it reaches.

    links: two BIGINT columns; loops and nulls are ignored, direction and repeats don't matter.
    """
    edges = links.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).where("v <> u")
    edges = written(edges.mapInArrow(_forest, "v long, u long").distinct(), "links")
    before = None
    while True:
        after = written(_stars(_stars(edges, small=False), small=True), "links")
        drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.hash("v", "u").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select("v", F.col("u").alias("component"))
            out._tessera_path = edges._tessera_path
            return out
        before = now
