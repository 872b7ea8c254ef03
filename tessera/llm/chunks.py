"""Repeated passages by content-defined chunking: chunks end where a gear rolling hash is least.

The hash h = 2h + GEAR[byte] rolls over the bytes; at the end of a word it is taken of the word and
the one before it (of their last 32 bytes). Of every WINDOW neighbouring words of a text the one of
the least hash ends a chunk, ties to the first. Ends depend on the words of one window only, so
equal stretches have equal ends, whatever is inserted elsewhere, and no chunk between two ends has
more than WINDOW words. A chunk whose digest (64 bits, and its length) has an earlier place in the
table is a repeat; neighbouring repeats are one passage, reported from min_words on. Of a repeated
passage of n words the repeated chunks hold n - 2 * WINDOW words at least: one of min_words +
2 * WINDOW = 50 words is always found.
Chunks are never joined with others in groups: digests are counted and their first places joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tables import written
from tessera.llm.textvec import NON_SPACE, Texts, mix, slices

#: words of which one ends a chunk: the most words of a chunk, about twice the mean
WINDOW = 15
#: words of a reported passage
MIN_WORDS = 20
#: bytes of the rolling hash
REACH = 32
#: bits of a chunk's number that tell texts apart, and what stands for a null doc_id inside
TEXT_BITS, NO_ID = 24, 2**63 - 1

GEAR = (mix(np.arange(256, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling: sums of 1, 2, 4, ... 32 bytes."""
    h = GEAR[raw]
    reach = 1
    while reach < REACH:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, 2 * reach
    return h


def gear_of(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash rolled over the bytes start..stop-1 alone: what came before is shifted and taken off."""
    size = np.minimum(stop - start, REACH)
    before = np.where((start > 0) & (size < REACH), h[np.maximum(start - 1, 0)], 0).astype(np.uint32)
    return h[stop - 1] - (before << np.minimum(size, REACH - 1).astype(np.uint32))


def cut(texts: Texts, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of every chunk, in order; what stands in other rows doesn't count."""
    if not len(texts.raw):
        return (np.zeros(0, np.int64),) * 3
    first, last, row = texts.tokens(NON_SPACE)
    # the first word of a row has none before it and ends no chunk
    second = np.flatnonzero(row[1:] == row[:-1]) + 1
    pairs = mix(gear_of(gear(texts.raw), first[second - 1], last[second]).astype(np.uint64))
    # the place in the low half: ties go to the first
    least = (pairs & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(pairs), dtype=np.uint64)
    for k in _steps(window):
        least = np.minimum(least[:-k], least[k:]) if len(least) > k else least[:0]
    inside = row[second[: len(least)]] == row[second[len(second) - len(least) :]]
    chosen = np.unique(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end = np.zeros(len(texts.raw), dtype=bool)
    end[last[second[chosen]] - 1] = True
    end[texts.ends[texts.ends > texts.starts] - 1] = True
    stops = np.flatnonzero(end) + 1
    starts = np.append(0, stops[:-1])
    return np.searchsorted(texts.ends, starts, side="right"), starts, stops


def _steps(window: int) -> list[int]:
    """Shifts whose minima, taken one after the other, cover window places: 1, 2, 4, ... and the rest."""
    steps, reach = [], 1
    while reach < window:
        steps.append(min(reach, window - reach))
        reach += steps[-1]
    return steps


def _chunks(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                rows, starts, stops = cut(texts, window)
                kind = NON_SPACE[texts.raw]
                begins = kind.astype(np.int64)
                if len(begins) > 1:
                    begins[1:] &= 1 - kind[:-1]
                begins[texts.starts[texts.starts < texts.ends]] = kind[texts.starts[texts.starts < texts.ends]]
                words = np.append(0, np.cumsum(begins))
                inside = np.append(0, np.cumsum((texts.raw & 0xC0) != 0x80))  # characters
                first = np.searchsorted(rows, np.arange(part.num_rows))
                base = inside[texts.starts[rows]]
                # the high bits tell texts of one doc_id apart
                text = texts.hashes(texts.starts, texts.ends, lower=False) >> np.uint64(64 - TEXT_BITS) << np.uint64(63 - TEXT_BITS)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)),
                        pa.array((np.arange(len(rows)) - first[rows]) + text[rows].view(np.int64)),
                        pa.array((inside[starts] - base).astype(np.int32)),
                        pa.array((inside[stops] - inside[starts]).astype(np.int32)),
                        pa.array((words[stops] - words[starts]).astype(np.int32)),
                        pa.array(texts.hashes(starts, stops, lower=False).view(np.int64)),
                    ],
                    names=["doc_id", "chunk", "at", "n_chars", "n_words", "digest"],
                )

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, first_char, n_chars, n_words, source_doc_id: the later copies of repeated passages.

    docs: doc_id, text. A passage is a run of chunks each of which stands earlier in the table, by
    (doc_id, text, place), null ids last; its source is the first document of its longest chunk, and
    in a row with the same doc_id it is a repeat within the document or between its texts. Rows that
    repeat a doc_id with another text are texts of their own, rows that repeat both are one. Null and
    empty texts have no chunks. Other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = written(docs.mapInArrow(_chunks(window), "doc_id long, chunk long, at int, n_chars int, n_words int, digest long"), "chunks")
    firsts = chunks.groupBy("digest", "n_chars").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = chunks.join(firsts, ["digest", "n_chars"])
    # in the source itself only the first place counts as first; rows repeated whole share their places
    inside = W.partitionBy("digest", "n_chars", "doc_id").orderBy("chunk")
    own = again.where("doc_id = source").withColumn("k", F.dense_rank().over(inside)).where("k > 1").drop("k")
    later = again.where("doc_id <> source").unionByName(own).select("doc_id", F.shiftright("chunk", 63 - TEXT_BITS).alias("t"), "chunk", "at", "n_chars", "n_words", "source")
    by_chunk = W.partitionBy("doc_id", "t").orderBy("chunk")
    later = later.withColumn("run", F.col("chunk") - F.dense_rank().over(by_chunk)).withColumn("before", F.lag("chunk").over(by_chunk)).where("before IS NULL OR before < chunk")
    runs = later.groupBy("doc_id", "t", "run").agg(
        F.min("at").cast("long").alias("first_char"),
        (F.max(F.col("at") + F.col("n_chars")) - F.min("at")).cast("long").alias("n_chars"),
        F.sum("n_words").alias("n_words"),
        F.max(F.struct(F.col("n_chars"), (-F.col("source")).alias("s"))).alias("longest"),
    )
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    return runs.where(F.col("n_words") >= min_words).select(named(F.col("doc_id")).alias("doc_id"), "first_char", "n_chars", "n_words", named(-F.col("longest.s")).alias("source_doc_id"))
