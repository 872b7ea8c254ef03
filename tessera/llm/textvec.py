"""Vectorised text kernels: tokens and hashes of many texts at once, on numpy arrays.

A batch of texts is one byte array plus row offsets; tokens are maximal runs of bytes of one class
inside a row. Hashes are 64 bits and depend on the token's bytes alone, so they agree between
partitions, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: keeps the first n bytes of a little-endian 8-byte load
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: class 1 = token, 0 = separator
NON_SPACE = np.ones(256, dtype=np.uint8)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
#: ASCII letters and digits and every byte of a multi-byte character
ALNUM = np.zeros(256, dtype=np.uint8)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: letters and digits are class 1, other visible ASCII is class 2
WORDS_AND_MARKS = ALNUM.copy()
WORDS_AND_MARKS[[b for b in range(0x21, 0x7F) if not ALNUM[b]]] = 2


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


class Texts:
    """Rows of an Arrow string column as bytes; nulls count as empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
        column = column.cast(pa.large_string()).fill_null("")
        n, (_, offsets, data) = len(column), column.buffers()
        self.ends = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
        base = int(self.ends[0])
        self.raw = np.frombuffer(data, dtype=np.uint8, count=int(self.ends[-1]) - base, offset=base) if data is not None and len(data) else np.zeros(0, np.uint8)
        self.starts, self.ends = self.ends[:-1] - base, self.ends[1:] - base
        self.n = n

    def tokens(self, classes: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte and row of every token, in order."""
        kind = classes[self.raw]
        if not len(kind):
            return (np.zeros(0, np.int64),) * 3
        new = np.empty(len(kind), dtype=bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        full = self.starts < self.ends
        new[self.starts[full]] = True
        cuts = np.flatnonzero(new)
        stops = np.append(cuts[1:], len(kind))
        word = kind[cuts] != 0
        starts, stops = cuts[word], stops[word]
        return starts, stops, np.searchsorted(self.ends, starts, side="right")

    def hashes(self, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, A-Z lower-cased if asked."""
        data = np.zeros(len(self.raw) + 8, dtype=np.uint8)
        data[:-8] = LOWER[self.raw] if lower else self.raw
        loads = np.ndarray(shape=(len(self.raw) + 1,), dtype="<u8", buffer=data, strides=(1,))
        size = stops - starts
        out = mix(size.astype(np.uint64))
        left, at, sel = size, starts, None
        while len(left):
            part = loads[at] & _KEEP[np.minimum(left, 8)]
            if sel is None:
                out = mix(out ^ part)
            else:
                out[sel] = mix(out[sel] ^ part)
            more = left > 8
            sel = np.flatnonzero(more) if sel is None else sel[more]
            left, at = left[more] - 8, at[more] + 8
        return out


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n neighbouring words of one row."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(words) - n + 1
    out = np.zeros(last, dtype=np.uint64)
    for k in range(n):
        out = out * U64(0xD6E8FEB86659FD93) + words[k : k + last]
    inside = rows[:last] == rows[n - 1 :]
    return mix(out[inside]), rows[:last][inside]


def shingle_sets(texts: Texts, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, last): the sorted distinct shingles of row i are hashes[first[i]:last[i]].

    A row of one to n-1 words has one shingle, the whole sequence; a row without words has none.
    """
    starts, stops, rows = texts.tokens()
    words = texts.hashes(starts, stops)
    got, at = grams(words, rows, n)
    count = np.bincount(rows, minlength=texts.n)
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([mix(np.array([_fold(words[b : b + c]) ^ c], dtype=np.uint64))[0] for b, c in zip(begin[short].tolist(), count[short].tolist(), strict=True)], dtype=np.uint64)
        got, at = np.concatenate([got, whole]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        got, at = got[order], at[order]
    size = np.bincount(at, minlength=texts.n)
    last = np.cumsum(size)
    sets = [_distinct(got[a:b]) for a, b in zip((last - size).tolist(), last.tolist(), strict=True)]
    last = np.cumsum([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else got), last - np.array([len(s) for s in sets], dtype=np.int64), last


def _distinct(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def _fold(words: np.ndarray) -> int:
    out = 0
    for w in words.tolist():
        out = (out * 0xA0761D6478BD642F + w + 1) & (2**64 - 1)
    return out


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about most_bytes (one row at least)."""
    if not batch.num_rows:
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    begin, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if total and total + s > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    yield batch.slice(begin)
