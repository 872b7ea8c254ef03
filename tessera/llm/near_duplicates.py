"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

SuperMinHash gives each element a random permutation of the slots and writes its j-th draw,
j + r with r in [0, 1), to the j-th slot of that permutation; a slot keeps its least value. Draws
of level j are never below j, so a text is finished after the first level at which every slot has
a value: here all elements of a batch go through the levels together.

Texts with equal shingle sets are one vertex. Pairs of vertices that share a band are candidates:
first each vertex against the least vertex of its bucket, then, in buckets whose members are still
in several components, the pairs of different components. Pairs inside a component are never made.
A pair goes on only if an exact bound lets it through: every set has a bitmap of 4 to 8 slots a
shingle, and a slot that one set fills and the other doesn't stands for a shingle not shared. So
a group of many texts that resemble each other less than asked ends there, without their texts.
Only then are texts read, once for all candidates, and every link is confirmed on full shingle
sets. With 40 bands of 5 rows a pair at similarity 0.75 is a candidate with probability 1 - 2e-5,
at 0.8 with 1 - 2e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.tables import drop, written
from tessera.llm.textvec import U64, Texts, mix, shingle_sets, slices

SHINGLE_WORDS = 5
BANDS, ROWS = 40, 5
#: tasks that the rows of one shingle set are dealt over
SALTS = 16


def _draws(h: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of this level, and the slot to swap with: level or a later one."""
    x = mix(h ^ U64((level + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1)))
    return level + (x >> U64(11)).astype(np.float64) * 2.0**-53, level + (mix(x) % U64(slots - level)).astype(np.int64)


def superminhash(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, one row for each set hashes[first:last]; a row of infinities for an empty set."""
    n = len(first)
    sig = np.full(n * slots, np.inf)
    row = np.repeat(np.arange(n), last - first)
    value, slot = _draws(hashes, 0, slots)
    np.minimum.at(sig, row * slots + slot, value)
    table = sig.reshape(n, slots)
    open_rows = np.flatnonzero((last > first) & np.isinf(table).any(axis=1))
    begin = 0
    while begin < len(open_rows):  # so many rows that their permutations stay small
        sizes = np.cumsum(last[open_rows[begin:]] - first[open_rows[begin:]])
        stop = begin + max(1, int(np.searchsorted(sizes, 40_000, side="right")))
        rows = open_rows[begin:stop]
        begin = stop
        at = np.concatenate([np.arange(first[i], last[i]) for i in rows])
        h, row = hashes[at], np.repeat(rows, last[rows] - first[rows])
        perm = np.tile(np.arange(slots, dtype=np.uint16), (len(h), 1))
        _swap(perm, 0, _draws(h, 0, slots)[1])
        for level in range(1, slots):
            value, slot = _draws(h, level, slots)
            _swap(perm, level, slot)
            np.minimum.at(sig, row * slots + perm[:, level], value)
            undone = table[row].max(axis=1) >= level + 1 if len(h) < 64 else np.isin(row, rows[table[rows].max(axis=1) >= level + 1])
            if not undone.all():
                h, row, perm = h[undone], row[undone], perm[undone]
                if not len(h):
                    break
    return table


def _swap(perm: np.ndarray, level: int, slot: np.ndarray) -> None:
    i = np.arange(len(perm))
    was = perm[i, slot]
    perm[i, slot] = perm[:, level]
    perm[:, level] = was


def _digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    total = lambda x: np.append(U64(0), np.cumsum(x, dtype=np.uint64))
    a, b = total(mix(hashes ^ U64(0x165667B19E3779F9))), total(mix(hashes ^ U64(0x27D4EB2F165667C5)))
    return a[last] - a[first], b[last] - b[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bitmaps(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.ListArray:
    """For each set, which slots its shingles fall into: a power of two of 64-bit words, n / 16 at least."""
    n = last - first
    words = np.where(n > 0, 2 ** np.ceil(np.log2(np.maximum(n / 16, 1))).astype(np.int64), 0)
    offsets = np.append(0, np.cumsum(words))
    table = np.zeros(64 * int(offsets[-1]), dtype=bool)
    row = np.repeat(np.arange(len(n)), n)
    slot = mix(hashes ^ U64(0x2B7E151628AED2A6)) & (64 * words[row] - 1).astype(np.uint64)
    table[64 * offsets[row] + slot.astype(np.int64)] = True
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.packbits(table, bitorder="little").view(np.int64)))


def _may_link(percent: int) -> str:
    """Whether sets of n and m shingles with bitmaps w and v can be similar enough, by an exact bound.

    The longer bitmap is folded once where it is twice as long, which from 50 percent on is the most
    that sizes allow; below that, pairs of other lengths pass. The shared shingles are at most the size less the slots that the other set leaves empty.
    """
    folded = lambda x, y: f"IF(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p | q), {x})"
    fits = lambda size, x, y: f"{100 + percent} * ({size} - aggregate(zip_with({folded(x, y)}, {folded(y, x)}, (p, q) -> bit_count(p & ~q)), 0, (s, k) -> s + k)) >= {percent} * (n + m)"
    return f"100 * least(n, m) >= {percent} * greatest(n, m) AND (2 * least(size(w), size(v)) < greatest(size(w), size(v)) OR ({fits('n', 'w', 'v')} AND {fits('m', 'v', 'w')}))"


def _sign(bands: int, rows: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first, last = shingle_sets(Texts(part.column("text")), words)
                sig = superminhash(hashes, first, last, bands * rows).view(np.uint64).reshape(-1, bands, rows)
                key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), sig.shape[:2]).copy()
                for r in range(rows):
                    key = mix(key ^ sig[:, :, r])
                a, b = _digests(hashes, first, last)
                n = last - first
                full = np.flatnonzero(n > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, bands, 0))).astype(np.int32)), _signed(key[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), _signed(a), _signed(b), lists, _bitmaps(hashes, first, last)], names=["doc_id", "n_shingles", "d1", "d2", "bands", "bitmap"])

    return run


def _confirm(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, text_a, text_b) -> (a, b) of the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for part in slices(batch, "text_a"):
                a_id, b_id = part.column("a").to_pylist(), part.column("b").to_pylist()
                ha, fa, la = shingle_sets(Texts(part.column("text_a")), words)
                keep = []
                for i, text in enumerate(part.column("text_b")):
                    if held[0] != (text := text.as_py()):  # rows of one text mostly come together
                        held = (text, shingle_sets(Texts(part.column("text_b").slice(i, 1)), words)[0])
                    x, y = ha[fa[i] : la[i]], held[1]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a_id[i] for i in keep], pa.int64()), pa.array([b_id[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that full shingle sets confirm, written. texts: doc_id, text of all of them."""
    # neither the pairs nor the texts have a size bound: no side is broadcast
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        .select("a", "b", "text_a", "text_b")
        .sortWithinPartitions("b")
    )
    return written(both.mapInArrow(_confirm(words, percent), "a long, b long"), "confirmed")


def _representatives(signed: DataFrame) -> DataFrame:
    """signed with rep, the least doc_id of an equal shingle set (by both digests and the size).

    Only sets that stand in several rows are joined, dealt over SALTS tasks each.
    """
    key = ["d1", "d2", "n_shingles"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    part = signed.select(*key, "doc_id").withColumn("salt", salt)
    some = part.groupBy(*key, "salt").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")).groupBy(*key).agg(F.min("low").alias("low"), F.sum("k").alias("k"))
    many = some.where("k > 1").select(*key, "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return signed.withColumn("salt", salt).join(many.hint("merge"), [*key, "salt"], "left").withColumn("rep", F.coalesce("low", "doc_id")).drop("salt", "low")


def near_duplicate_groups(docs: DataFrame, percent: int = 75, words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of docs (doc_id, text, ...).

    A text of fewer words than a shingle is one shingle. Null texts, empty texts and texts without
    words have no shingles and link with nothing. Rows of a null doc_id link with nothing: their
    component_id is null and they are kept. Rows that repeat a doc_id are one document, which has
    the links of all their texts: all are kept, or none. Other columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_sign(bands, rows, words), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bitmap array<long>"), "signatures")
    alone = "doc_id IS NULL OR n_shingles = 0"
    reps = written(_representatives(signed.where(f"NOT ({alone})").select("doc_id", "n_shingles", "d1", "d2")).select("doc_id", "n_shingles", "d1", "d2", "rep"), "representatives")
    # a vertex is a representative; it has the bands of all its rows
    vertices = written(signed.join(reps.where("doc_id = rep").select("doc_id", "n_shingles", "d1", "d2").distinct().hint("merge"), ["doc_id", "n_shingles", "d1", "d2"], "left_semi"), "vertices")
    buckets = vertices.select(F.col("doc_id").alias("a"), F.explode("bands").alias("key"))
    leads = buckets.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b < z").select("key", "b")
    shared = written(buckets.join(leads.hint("merge"), "key").distinct(), "buckets")
    own = vertices.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("bitmap").alias("w"))
    theirs = own.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("w").alias("v"))
    may_link = _may_link(percent)
    pairs = shared.where("a <> b").select("a", "b").distinct()
    close = written(pairs.join(own.hint("merge"), "a").join(theirs.hint("merge"), "b").where(may_link).select("a", "b").distinct(), "pairs")
    texts = written(docs.join(shared.select(F.col("a").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    links = _linked(close, texts, words, percent)
    found = components(links, "a", "b")
    # Members whose component isn't the bucket's lead's are tried against the bucket's other components.
    label = found.select(F.col("v").alias("a"), "component")
    members = shared.join(label, "a", "left").select("key", "a", F.coalesce("component", "a").alias("c"))
    split = members.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    open_members = written(members.join(split.hint("merge"), "key", "left_semi").join(own.hint("merge"), "a"), "open")
    other = open_members.select("key", F.col("a").alias("b"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("w").alias("v"))
    crossing = open_members.join(other, "key").where(f"c > d AND {may_link}").select("a", "b").distinct()
    crossing = written(crossing.join(close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti"), "crossing")
    more = _linked(crossing, texts, words, percent)
    # rows of one doc_id with several sets hold their representatives together
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("z")).where("b < z").select("doc_id", "b")
    same_id = reps.join(several.hint("merge"), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    final = components(links.unionByName(more).unionByName(same_id), "a", "b")
    linked = reps.join(final.withColumnRenamed("v", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    empty = signed.where(alone).select("doc_id", "n_shingles")
    known = linked.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    rest = empty.join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = linked.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = written(out, "groups")
    drop(signed, reps, vertices, shared, close, texts, links, found, open_members, crossing, more, final)
    return out
