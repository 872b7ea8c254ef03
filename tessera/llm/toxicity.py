"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled rows; every word of their texts is a term. A term
weighs (1 + ln tf) * ln(1 + N / df) * r: N and df count every document of the corpus, and r, from
FLOOR to 1, says how well the term tells the examples' labels apart (chi-square x with continuity
correction, as x^4 / (x^4 + DOUBT^4)). No term is left out; words that no example holds can't add to any cosine and are not
counted in a text's length. Vectors have length 1.

The index keeps, for each term, its examples by blocks of BLOCK, a pointer to each block's and the
largest weight there. Examples of the same strongest shared term stand together, so that blocks differ. A
query adds up block bounds, scores the most promising blocks first, reads no posting of a block
whose bound is below the k-th best cosine so far: the k nearest are exact, ties by doc_id. A
document that is an example itself is scored as if that example weren't there. A neighbour votes with weight
1 / (1.05 - cosine). The share of toxic votes and the best cosine are turned into a probability by
a logistic curve fitted to the examples themselves, each without its own vote, and moved to the
share of toxic labels among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.textvec import ALNUM, Texts, slices

#: bounds of the fit: examples of each label, and bytes of their texts
EXAMPLES_PER_LABEL = 1500
EXAMPLE_BYTES = 32 << 20
#: share of its weight that a term keeps which tells nothing, and the chi-square at half of the rest
FLOOR, DOUBT = 0.02, 25.0
NEIGHBOURS = 15
BLOCK = 16


def distinct_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, tf) of every distinct word of every row; words are letters and digits."""
    starts, stops, rows = texts.tokens(ALNUM)
    h = texts.hashes(starts, stops)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    h, rows = h[order], rows[order]
    if not len(h):
        return rows, h, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])))
    return rows[first], h[first], np.diff(np.append(first, len(h)))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0]..end[0]-1, begin[1]..end[1]-1, and so on."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@dataclass
class Index:
    """Term t's blocks are entries first[t]:first[t+1], entry e's postings start[e]:start[e+1]."""

    terms: np.ndarray  # sorted hashes
    gain: np.ndarray  # of each term: idf and how well it tells labels apart
    first: np.ndarray
    block: np.ndarray  # of each entry
    top: np.ndarray  # largest weight of each entry
    start: np.ndarray
    ids: np.ndarray  # example of each posting
    weights: np.ndarray
    labels: np.ndarray
    keys: np.ndarray  # doc_id of each example
    base: float  # share of toxic labels among all labelled rows
    curve: np.ndarray

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms, and where."""
        if not len(self.terms):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return self.terms[at] == h, at

    def vector(self, h: np.ndarray, tf: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, of length 1; terms of one example alone are none without it."""
        known, at = self.lookup(h)
        if without >= 0:
            place = self.start[self.first[at]]
            known &= (self.start[self.first[at + 1]] - place > 1) | (self.ids[place] != without)
        t = at[known]
        w = (1 + np.log(tf[known])) * self.gain[t]
        norm = np.sqrt((w * w).sum())
        return (t, w / norm) if norm > 0 else (t[:0], w[:0])

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, without: int = -1, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine; ties to the smaller doc_id.

        read: postings read and postings of the query's terms are added to it.
        """
        if not len(t):
            return np.zeros(0, np.int64), np.zeros(0)
        entries = _ranges(self.first[t], self.first[t + 1])
        gain = np.repeat(w, self.first[t + 1] - self.first[t])
        blocks = self.block[entries]
        bound = np.bincount(blocks, weights=gain * self.top[entries])
        todo = np.argsort(-bound, kind="stable")
        todo = todo[bound[todo] > 0]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        begin, step = 0, 4
        while begin < len(todo):
            stop = len(todo)
            if len(best) >= k:  # no block from here on reaches the k-th best
                stop = int(np.searchsorted(-bound[todo], -(best[k - 1] - 1e-9), side="right"))
                if stop <= begin:
                    break
            part = todo[begin : min(stop, begin + step)]
            begin, step = begin + len(part), step * 2
            here = np.zeros(len(bound), bool)
            here[part] = True
            sel = here[blocks]
            begins, ends = self.start[entries[sel]], self.start[entries[sel] + 1]
            slots = _ranges(begins, ends)
            score = np.bincount(self.ids[slots], weights=np.repeat(gain[sel], ends - begins) * self.weights[slots])
            if read is not None:
                read[0] += len(slots)
            found = np.flatnonzero(score > 0)
            found = found[found != without]
            ids, scores = np.append(best_ids, found), np.append(best, np.round(score[found], 12))
            if len(scores) > k:
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[near], scores[near]
            order = np.lexsort((self.keys[ids], -scores))[:k]
            best_ids, best = ids[order], scores[order]
        if read is not None:
            read[1] += int((self.start[self.first[t + 1]] - self.start[self.first[t]]).sum())
        return best_ids, best

    def widened(self) -> Index:
        """The same index with machine-word integers: a search converts none, at four bytes more a number."""
        return replace(self, **{n: getattr(self, n).astype(np.intp) for n in ("first", "block", "start", "ids")})

    def evidence(self, ids: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """What the calibration curve reads: log odds of the votes, and how near and how many they are."""
        if not len(ids):
            return np.array([1.0, 0.0, 0.0, 0.0])
        vote = 1 / (1.05 - np.minimum(cosines, 1))
        toxic = float((vote * self.labels[ids]).sum())
        clean = float(vote.sum()) - toxic
        return np.array([1.0, np.log((toxic + 0.5) / (clean + 0.5)), float(cosines[0]), 1.0])


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge; both labels weigh the same."""
    beta = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.5 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, grad)
    return beta


def telling(by_label: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int]) -> np.ndarray:
    """FLOOR to 1 for each term, from how many examples of label 0 and of label 1 hold it."""
    (b, a), (n0, n1) = by_label, sizes
    chi = np.maximum(np.abs(a * (n0 - b) - b * (n1 - a)) - (n1 + n0) / 2, 0) ** 2 * (n1 + n0) / np.maximum((a + b) * np.maximum(n1 + n0 - a - b, 1) * max(n1, 1) * max(n0, 1), 1)
    return FLOOR + (1 - FLOOR) * chi**4 / (chi**4 + DOUBT**4)


def build(keys: np.ndarray, labels: np.ndarray, rows: np.ndarray, h: np.ndarray, tf: np.ndarray, frequency: tuple[np.ndarray, np.ndarray], n_docs: int, base: float) -> Index:
    """keys, labels: doc_id and label of the examples; rows, h, tf: their terms (see distinct_terms);
    frequency: sorted hashes of terms, and documents of each."""
    keys, labels = np.asarray(keys, np.int64), np.asarray(labels, np.float64)
    terms = np.unique(h)
    term = np.searchsorted(terms, h).astype(np.int32)
    df = np.ones(len(terms))
    if len(frequency[0]):
        at = np.minimum(np.searchsorted(frequency[0], terms), len(frequency[0]) - 1)
        df = np.where(frequency[0][at] == terms, frequency[1][at], 1).astype(np.float64)
    held = tuple(np.bincount(term[labels[rows] == y], minlength=len(terms)).astype(np.float64) for y in (0, 1))
    gain = np.log1p(n_docs / np.maximum(df, 1)) * telling(held, (int((labels == 0).sum()), int((labels == 1).sum())))
    w = (1 + np.log(tf)) * gain[term]
    norm = np.sqrt(np.bincount(rows, weights=w * w, minlength=len(keys)))
    w = w / np.maximum(norm[rows], 1e-300)
    # examples in order of the strongest of their terms that several share, then of doc_id
    strongest = np.full(len(keys), -1)
    by_weight = np.lexsort((term, w))
    by_weight = by_weight[np.bincount(term, minlength=len(terms))[term[by_weight]] >= BLOCK // 2]
    strongest[rows[by_weight]] = term[by_weight]
    order = np.lexsort((keys, strongest))
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys))
    ids = place[rows]
    del by_weight
    by_term = np.lexsort((ids, term))
    term, ids, w = term[by_term], ids[by_term], w[by_term]
    block = ids // BLOCK
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(w, new) if len(new) else np.zeros(0)
    index = Index(terms, gain, np.searchsorted(term[new], np.arange(len(terms) + 1)).astype(np.int32), block[new], top, np.append(new, len(term)).astype(np.int32), ids, w, labels[order], keys[order], base, np.zeros(4))
    del term, block, by_term
    if len(keys):
        x = []
        own = np.argsort(rows, kind="stable")
        cut = np.searchsorted(rows[own], np.arange(len(keys) + 1))
        for old in order.tolist():
            mine = own[cut[old] : cut[old + 1]]
            x.append(index.evidence(*index.nearest(*index.vector(h[mine], tf[mine], int(place[old])), NEIGHBOURS, int(place[old]))))
        index.curve = _fit_curve(np.array(x), index.labels)
    return index


def score(index: Index, ids: np.ndarray, cosines: np.ndarray) -> float:
    z = float(index.evidence(ids, cosines) @ index.curve)
    # the curve holds for labels of equal shares; move it to the shares there are
    base = min(max(index.base, 1e-3), 1 - 1e-3)
    return 1 / (1 + np.exp(-np.clip(z + np.log(base / (1 - base)), -30, 30)))


def _count(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of a partition that hold each of the (sorted) terms; term 0 stands for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                n += part.num_rows
                texts = Texts(part.column("text"))
                starts, stops, rows = texts.tokens(ALNUM)
                h = texts.hashes(starts, stops)
                if len(h) and len(terms):
                    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                    known = terms[at] == h
                    pairs = np.unique(rows[known] * len(terms) + at[known])
                    total += np.bincount(pairs % len(terms), minlength=len(terms))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms[held], np.uint64(0)).view(np.int64)), pa.array(np.append(total[held], n))], names=["term", "n"])

    return run


def _judge(held: object, k: int, below: float | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores and evidence of each row, or, with a limit, the rows that score below it as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value.widened()
        own = {int(key): i for i, key in enumerate(index.keys.tolist())}
        for batch in batches:
            for part in slices(batch, "text"):
                rows, h, tf = distinct_terms(Texts(part.column("text")))
                begin = np.searchsorted(rows, np.arange(part.num_rows + 1))
                scores, near, cos = np.zeros(part.num_rows), [], []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    without = own.get(doc_id, -1)
                    t, w = index.vector(h[begin[i] : begin[i + 1]], tf[begin[i] : begin[i + 1]], without)
                    ids, c = index.nearest(t, w, k, without)
                    scores[i] = score(index, ids, c)
                    near.append(index.keys[ids])
                    cos.append(c)
                if below is not None:
                    yield part.filter(pa.array(scores < below))
                    continue
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in near])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in ((near, pa.int64()), (cos, pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), *lists], names=["doc_id", "score", "neighbours", "cosines"])

    return run


def fit(docs: DataFrame, labels: DataFrame, examples_per_label: int = EXAMPLES_PER_LABEL, example_bytes: int = EXAMPLE_BYTES) -> Index:
    """The index of labelled examples. labels: doc_id and label (0 or 1); docs: doc_id and text.

    Labels that are null or neither 0 nor 1, and labels of documents not there, are left out; of
    several labels of one doc_id the largest holds, and of several texts the one of the least md5.
    The examples are those of the smallest md5 of the doc_id, examples_per_label of each label at
    most and as many as hold example_bytes bytes of text; document frequencies are of all docs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clean = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = dict(clean.groupBy("label").count().collect())
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for label in (0, 1):
        some = clean.where(F.col("label") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(examples_per_label)
        picked = some if picked is None else picked.unionByName(some)
    # picked has 2 * examples_per_label rows at most
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.octet_length("text"))
    found = found.where(F.col("size") <= example_bytes).groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.md5("text"), "text")).alias("one")).select("doc_id", "label", "one.text")
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("label").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    examples = found.withColumn("so_far", so_far).where(F.col("so_far") <= example_bytes).select("doc_id", "label", "text").orderBy("doc_id").toArrow()
    keys, y = examples.column("doc_id").to_numpy(), examples.column("label").to_numpy()
    # a slice of the texts at a time, in small integers: the driver holds little more than the index
    parts, begin = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32))], 0
    for batch in examples.to_batches():
        for part in slices(batch, "text", 1 << 20):
            rows, h, tf = distinct_terms(Texts(part.column("text")))
            parts.append(((rows + begin).astype(np.int32), h, tf.astype(np.int32)))
            begin += part.num_rows
    del examples
    rows, h, tf = (np.concatenate([p[k] for p in parts]) for k in range(3))
    del parts
    counted = docs.select("text").mapInArrow(_count(np.unique(h)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    known, n = counted.column("term").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    order = np.argsort(known, kind="stable")  # hash 0 comes first and stands for all documents
    frequency = known[order], n[order]
    n_docs = int(frequency[1][0]) if len(known) and frequency[0][0] == 0 else 0
    index = build(keys, y, rows, h, tf, frequency, n_docs, base)
    del counted, known, n, rows, h, tf
    pa.default_memory_pool().release_unused()
    return index


def toxicity(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, neighbours, cosines, one row for each row of docs (doc_id, text, ...).

    neighbours are the doc_ids of the nearest labelled examples, nearest first, and cosines their
    similarities; a document's own example is not among them. Texts without a known term (null and
    empty ones too) have no neighbours and the score of a text that resembles no example. Rows that
    repeat a doc_id are scored each by its text. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(index)
    return docs.mapInArrow(_judge(held, k), "doc_id long, score double, neighbours array<long>, cosines array<double>")


def keep_clean(docs: DataFrame, index: Index, below: float, k: int = NEIGHBOURS) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that score below the limit, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    return docs.mapInArrow(_judge(held, k, below), docs.schema)


def training_labels(labels: DataFrame, column: str, fold_of: int, held_fold: int, held: bool) -> DataFrame:
    """doc_id and label of the rows whose crc32(doc_id as text) mod fold_of is held_fold, or isn't."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold_of
    return labels.where(fold == held_fold if held else fold != held_fold).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label"))
