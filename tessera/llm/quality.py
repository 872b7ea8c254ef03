"""Quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other visible ASCII. Each token stands under its
lower-cased hash and under its shape: all capitals, repeat of the word before, mark, long or plain.
Features are tokens, pairs of neighbours and pairs of shapes, hashed to 2^BITS slots; a slot's
value is its share of the text's n-grams, times SCALE. A score is the sparse dot product of these
values with the weights, through the logistic function.

Training (FTRL-proximal, per coordinate, with L1 and L2) sees a bounded sample of the labelled
rows, in the order of the md5 of their doc_id, and keeps the whole text of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textvec import U64, WORDS_AND_MARKS, Texts, grams, mix, slices

#: bound of the fit: labelled rows
EXAMPLES = 6000
BITS = 16
SCALE = 12.0
EPOCHS = 3


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram of every row, repeats included; rows come in order within each kind."""
    starts, stops, rows = texts.tokens(WORDS_AND_MARKS)
    words = texts.hashes(starts, stops)
    size = stops - starts
    mark = WORDS_AND_MARKS[texts.raw[starts]] == 2 if len(starts) else np.zeros(0, bool)
    upper = (texts.raw >= 0x41) & (texts.raw <= 0x5A)
    small = (texts.raw >= 0x61) & (texts.raw <= 0x7A)
    sums = lambda m: np.append(0, np.cumsum(m))
    ups, lows = sums(upper), sums(small)
    capital = (ups[stops] - ups[starts] >= 2) & (lows[stops] == lows[starts])
    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shape = np.select([again, mark, capital, size > 24], [1, 2, 3, 4], 5).astype(np.uint64)
    shape = mix(shape ^ U64(0x5851F42D4C957F2D))
    kinds = [(words, rows), grams(words, rows, 2), (shape, rows), grams(shape, rows, 2)]
    mask = U64((1 << bits) - 1)
    return np.concatenate([r for _, r in kinds]), np.concatenate([mix(h ^ U64(k + 1)) & mask for k, (h, _) in enumerate(kinds)]).astype(np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.5) -> np.ndarray:
    """Weights (the bias last). rows: sorted slots and their values of each example."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for (slots, values), label in zip(rows, y.tolist(), strict=True):
            i, x = np.append(slots, bias), np.append(values, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-min(max(float(w @ x), -30.0), 30.0)))
            g = (p - label) * x
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / alpha * w
            n[i] += g2
    return weights(slice(None))


def _examples(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, slot = features(Texts(part.column("text")), bits)
                pairs, count = np.unique(row << bits | slot, return_counts=True)
                row, slot = pairs >> bits, pairs & ((1 << bits) - 1)
                total = np.bincount(row, weights=count, minlength=part.num_rows)
                value = (SCALE * count / total[row]).astype(np.float32)
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (slot.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *lists], names=["doc_id", "label", "slots", "shares"])

    return run


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, bits: int = BITS) -> np.ndarray:
    """Weights of the classifier. labels: doc_id and label (0 or 1); docs: doc_id and text.

    Labels that are null or neither 0 nor 1 are left out; of several labels of one doc_id the
    largest holds. Without labels all weights are 0 and every score is 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    picked = picked.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(examples)
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").mapInArrow(_examples(bits), "doc_id long, label int, slots array<int>, shares array<float>")
    t = found.toArrow()
    order = np.argsort(mix(t.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
    slots, shares = t.column("slots").combine_chunks(), t.column("shares").combine_chunks()
    rows = [(slots[i].values.to_numpy(), shares[i].values.to_numpy().astype(np.float64)) for i in order.tolist()]
    return train(rows, t.column("label").to_numpy().astype(np.float64)[order], bits)


def _judge(held: object, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                row, slot = features(Texts(part.column("text")), bits)
                total = np.maximum(np.bincount(row, minlength=part.num_rows), 1)
                z = SCALE * np.bincount(row, weights=w[slot], minlength=part.num_rows) / total + w[-1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score, one row for each row of docs (doc_id, text, ...).

    Null texts, empty texts and texts without tokens get the score of the bias alone. Other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_judge(held, bits), "doc_id long, score double")
