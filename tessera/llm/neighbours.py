"""Nearest neighbours by adaptive dimension scan inside probed lists.

Vectors are spread over lists by their nearest centroid (k-means on a bounded sample); lists grow
with the square root of the rows. A query goes to the lists that promise the largest inner
products: to so many that, inside the sample, those lists hold RECALL of the true neighbours.

All vectors are turned by one random rotation, so that any first columns are a random projection.
In a list the columns are read in blocks of STEP. A candidate whose product reaches the bar, the
k-th best so far, has bar * read / width of it in the columns read, give or take a known standard
deviation; one that falls EPSILON of these below is left out of the next block, as is one that even
the lengths of what is left can't lift to the bar. The bar starts at the query's k-th best in a
part of the sample, which are results themselves, rises after every block of candidates, and takes
in what the most promising lists hold before the others are searched. What is left is scored in double precision on
the original vectors, column after column.

Lists are cut into blocks of candidates and blocks of queries by a hash of the id, so that a list
that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import written

#: bounds of the fit: vectors that k-means and the choice of probes see, and of those that ask there
SAMPLE, ASKING = 16384, 512
#: vectors of the sample that set the first bar of every query
FIRST = 2048
#: one list in so many of the probed ones is searched first
FIRST_LISTS = 6
#: vectors of the sample for each list, at least
LEAST = 64
#: share of the neighbours inside the sample that the probed lists must hold
RECALL = 0.96
STEP = 16
EPSILON = 2.3
#: rows of a block of candidates or of queries in a task, on average, and of those that meet at once
BLOCK, MEET = 16384, (128, 2048)


def _array(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as float64, and which of them take part."""
    good = np.zeros(len(column), bool)
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        v = x.as_py()
        if v is not None and len(v) == width and all(y is not None for y in v):
            out[i] = v
            good[i] = np.isfinite(out[i]).all() and bool(out[i].any())
    out[~good] = 0
    return out, good


def _fast(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """_array for the common case of full rows."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([*column.chunks, pa.array([], column.type)])
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * width or not (np.diff(np.asarray(column.offsets)) == width).all():
        return _array(column, width)
    out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    good = np.isfinite(out).all(axis=1) & out.any(axis=1)
    return np.where(good[:, None], out, 0.0), good


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means from a seeded start; an empty list keeps its centroid."""
    rng = np.random.default_rng(7)
    if not len(sample):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    c = sample[np.sort(rng.choice(len(sample), size=min(lists, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * sample @ c.T, axis=1)
        for k in range(len(c)):
            mine = sample[near == k]
            if len(mine):
                c[k] = mine.mean(0)
    return c


def rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(11).normal(size=(width, width)))[0]


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int, turn: np.ndarray, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, product): for each query its k best candidates of another id, ties to smaller ids.

    floor: products known to be reached k times elsewhere; candidates well below may be left out.
    read: columns read and columns of all pairs are added to it.
    """
    width, out = x.shape[1], []
    xr, qr = x @ turn, q @ turn
    rest, q_rest = _remaining(xr), _remaining(qr)
    for begin in range(0, len(q), MEET[0]):
        mine = slice(begin, begin + MEET[0])
        bar = floor[mine].copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for at in range(0, len(x), MEET[1]):
            part = slice(at, at + MEET[1])
            so_far = qr[mine, :STEP] @ xr[part, :STEP].T
            alive = _stays(so_far, bar[:, None], rest[part, 0] * q_rest[mine, 0][:, None], rest[part, 1] * q_rest[mine, 1][:, None], min(STEP, width), width)
            i, j = np.nonzero(alive & (ids[part] != q_ids[mine][:, None]))
            if read is not None:
                read[0] += so_far.size * min(STEP, width)
                read[1] += so_far.size * width
            so_far, j = so_far[i, j], j + at
            for s, d in enumerate(range(STEP, width, STEP), 1):
                upto = min(d + STEP, width)
                so_far += np.einsum("ij,ij->i", qr[begin + i, d:upto], xr[j, d:upto])
                if read is not None:
                    read[0] += len(i) * (upto - d)
                stay = _stays(so_far, bar[i], rest[j, 0] * q_rest[begin + i, 0], rest[j, s + 1] * q_rest[begin + i, s + 1], upto, width)
                i, j, so_far = i[stay], j[stay], so_far[stay]
            best = _best(np.append(best[0], i), np.append(best[1], ids[j]), np.append(best[2], _products(x[j], q[begin + i])), k)
            full = np.bincount(best[0], minlength=len(bar)) >= k
            last = np.searchsorted(best[0], np.arange(len(bar)), side="right") - 1
            bar[full] = np.maximum(bar[full], best[2][last[full]])
        out.append((q_ids[begin + best[0]], best[1], best[2]))
    return tuple(np.concatenate([o[n] for o in out]) if out else np.zeros(0, kind) for n, kind in enumerate((np.int64, np.int64, np.float64)))


def _stays(so_far: np.ndarray, bar: np.ndarray, lengths: np.ndarray, left: np.ndarray, read: int, width: int) -> np.ndarray:
    """Whether products of which so_far is read may reach the bar. lengths: of whole vectors, left: of the rest, multiplied."""
    sure = so_far + left >= bar - 1e-9
    if read == width:
        return sure
    # what a product equal to the bar has in the columns read of a random rotation: mean and deviation
    doubt = EPSILON * np.sqrt(read * (width - read) / width**3) * np.sqrt(lengths**2 + np.where(np.isfinite(bar), bar, 0) ** 2)
    return sure & (so_far >= np.where(np.isfinite(bar), bar * read / width, -np.inf) - doubt)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order of query, then best first."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query, side="left")
    near = np.arange(len(query)) - first < k
    return query[near], ids[near], score[near]


def _remaining(x: np.ndarray) -> np.ndarray:
    """Lengths of what follows each step: columns 0, STEP, 2 * STEP, ... to the end."""
    tail = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    tail = np.concatenate([tail, np.zeros((len(x), 1))], axis=1)
    cuts = [*range(0, x.shape[1], STEP), x.shape[1]]
    return np.sqrt(np.maximum(tail[:, cuts], 0))


@dataclass
class Fit:
    """What a bounded sample says: the turn, centroids, how many lists to probe, and the sample itself."""

    turn: np.ndarray
    centroids: np.ndarray
    probes: int
    sample: np.ndarray
    ids: np.ndarray

    def homes(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centroids**2).sum(1) - 2 * x @ self.centroids.T, axis=1)

    def known(self, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, product), in order of query: the k best of each among the sample's FIRST, rows of its own id aside."""
        sample, own = self.sample[:FIRST], self.ids[:FIRST]
        product = np.where(own == ids[:, None], -np.inf, x @ sample.T)
        k = min(k, len(own))
        i = np.repeat(np.arange(len(x)), k)
        j = np.argpartition(-product, k - 1, axis=1)[:, :k].ravel()
        there = np.isfinite(product[i, j])
        i, j = i[there], j[there]
        return i, own[j], _products(sample[j], x[i])


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, in the order of the columns, as a sum of doubles."""
    score = np.zeros(len(x))
    for d in range(x.shape[1]):
        score += x[:, d] * q[:, d]
    return score


def fit(sample: np.ndarray, ids: np.ndarray, rows: int, k: int, lists: int | None = None, probes: int | None = None) -> Fit:
    """lists and probes are chosen from the sample and the number of rows where they aren't given."""
    width = sample.shape[1]
    c = centroids(sample, lists or max(1, min(len(sample) // LEAST, int(rows**0.5))))
    out = Fit(rotation(width), c, min(probes or len(c), len(c)), sample, ids)
    if probes is None and len(sample) > k:
        ask = slice(0, ASKING)
        product = sample[ask] @ sample.T
        product[ids[ask][:, None] == ids] = -np.inf
        top = np.argpartition(-product, k - 1, axis=1)[:, :k]
        rank = np.empty((len(product), len(c)), np.int64)
        np.put_along_axis(rank, np.argsort(-(sample[ask] @ c.T), axis=1, kind="stable"), np.arange(len(c))[None, :], axis=1)
        needed = np.sort(np.take_along_axis(rank, out.homes(sample)[top], axis=1).ravel())
        out.probes = int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1
    return out


def _vectors(table: pa.Table | pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return np.asarray(pa.concat_arrays([*pa.table({"v": table.column(column)}).column(0).chunks, pa.array([], table.schema.field(column).type)]).flatten(), dtype=np.float64).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.array(rows.reshape(-1)).cast(kind))


def _place(held: object, width: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, embedding) -> (vec_id, v, home) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _fast(batch.column("embedding"), width)
            ids = batch.column("vec_id").filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, _lists(x[good], kind), pa.array(held.value.homes(x[good]).astype(np.int32))], names=["vec_id", "v", "home"])

    return run


def _ask(held: object, width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, v) -> (vec_id, v, floor, probes) and the nearest of the sample (near, products)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Fit = held.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                x, ids = _vectors(part, "v", width), part.column("vec_id").to_numpy()
                probe = np.argsort(-(x @ known.centroids.T), axis=1, kind="stable")[:, : known.probes].astype(np.int32)
                i, near, score = known.known(x, ids, k)
                offsets = np.searchsorted(i, np.arange(len(x) + 1)).astype(np.int32)
                floor = np.full(len(x), np.inf)
                np.minimum.at(floor, i, score)
                floor[np.diff(offsets) < k] = -np.inf
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(y)) for y in (near, score)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(floor), _lists(probe, pa.int32()), *lists], names=["vec_id", "v", "floor", "probes", "near", "products"])

    return run


def _search(held: object, width: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(cands: pa.Table, queries: pa.Table) -> pa.Table:
        cands = cands.sort_by("vec_id")
        found = scan(_vectors(cands, "v", width), cands.column("vec_id").to_numpy(), _vectors(queries, "v", width), queries.column("vec_id").to_numpy(), queries.column("floor").to_numpy(), k, held.value.turn)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    return run


def _nearest_of_width(vectors: DataFrame, width: int, rows: int, queries: str, k: int, lists: int | None, probes: int | None, block: int) -> DataFrame:
    """query_id, vec_id, score: the best of each query, k at least where there are as many."""
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType
    arrow = pa.float32() if kind.elementType == T.FloatType() else pa.float64()
    # rows whose hash falls below a share, so that the driver sees about SAMPLE of them at any size
    share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, 1.2 * SAMPLE / rows) * (1 << 30))
    got = vectors.where(share).orderBy(F.md5(F.col("vec_id").cast("string")), "embedding").limit(SAMPLE).toArrow()
    x, good = _fast(got.column("embedding"), width)
    held = spark.sparkContext.broadcast(fit(x[good], got.column("vec_id").to_numpy()[good], rows, k, lists, probes))
    placed = written(vectors.mapInArrow(_place(held, width, arrow), T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", kind), T.StructField("home", T.IntegerType())])), "placed")
    ask = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", kind), T.StructField("floor", T.DoubleType()), T.StructField("probes", T.ArrayType(T.IntegerType())), T.StructField("near", T.ArrayType(T.LongType())), T.StructField("products", T.ArrayType(T.DoubleType()))])
    asks = written(placed.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_ask(held, width, k), ask), "asked")
    near = asks.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("near", "products")).alias("x")).select("query_id", F.col("x.near").alias("vec_id"), F.col("x.products").alias("score"))
    # the most promising lists first: what they hold raises the bar for the others
    most = held.value.probes
    n = -(-most // FIRST_LISTS)
    first = asks.select("vec_id", "v", "floor", F.explode(F.slice("probes", 1, n)).alias("home"))
    best = _ranked(near.unionByName(_meet(placed, first, held, width, k, block)), k).drop("rank")
    if n == most:
        return best
    best = written(best, "best")
    bars = best.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "bar")
    rest = asks.select("vec_id", "v", "floor", F.slice("probes", n + 1, most).alias("homes")).join(bars.hint("merge"), "vec_id", "left")
    rest = rest.select("vec_id", "v", F.greatest("floor", "bar").alias("floor"), F.explode("homes").alias("home"))
    return best.unionByName(_meet(placed, rest, held, width, k, block))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, each vec_id once."""
    # one exchange by query serves both the grouping and the ranks
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(placed: DataFrame, asked: DataFrame, held: object, width: int, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: what each query (vec_id, v, floor, home) finds in its list that reaches its floor."""
    blocks = placed.groupBy("home").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("cb"))
    rounds = asked.groupBy("home").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("qb"))
    plan = F.broadcast(blocks.join(F.broadcast(rounds), "home"))  # one row a list, SAMPLE / LEAST at most
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    cands = placed.join(plan, "home").withColumn("cs", salt("cb")).withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    asks = asked.join(plan, "home").withColumn("qs", salt("qb")).withColumn("cs", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)))
    key = ["home", "cs", "qs"]
    pick = lambda d, *more: d.select(*key, "vec_id", "v", *more).groupBy(*key)
    return pick(cands).cogroup(pick(asks, "floor")).applyInArrow(_search(held, width, k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, lists: int | None = None, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest inner product for each query.

    vectors: vec_id, embedding. A row takes no part if its id or vector is null, or its vector is
    empty, zero or holds a null or non-finite component. Vectors are compared with those of their
    own width. A vec_id asks once, with the least of its vectors; rows that repeat a vec_id are one
    candidate of the others' queries, with the largest product, and never one of their own id's.
    Fewer than k candidates: as many as there are. Other columns are not read.
    """
    kind = "float" if isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and vectors.schema["embedding"].dataType.elementType == T.FloatType() else "double"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    odd = (lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").where(~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0))
    widths = {r.width: r["count"] for r in vectors.groupBy(F.size("embedding").alias("width")).count().collect()}
    found = None
    for width, rows in sorted(widths.items()):
        here = _nearest_of_width(vectors.where(F.size("embedding") == width), width, rows, queries, k, lists, probes, block)
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    return _ranked(found, k)
