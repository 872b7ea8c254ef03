"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

Every state of the automaton stands for a set of word strings that end at the same places of the
items. Streaming a text's words through it gives, after each word, the length of the longest
string ending there that occurs in an item. A window - `window` consecutive words of an item, or
the whole item where it is shorter - occurs in the text exactly where that length reaches its own
and the state (or a suffix of it) is the window's.

Only stretches in which every pair of neighbouring words is a pair of neighbours in some item are
streamed: no window of two words or more reaches across another pair, so nothing is lost.

The benchmark is cut into pieces of PIECE words that overlap by a window less one word, so that
every window lies whole in one, and the pieces are dealt to blocks of about BLOCK_WORDS words. Each
block's automaton is built in a task and kept as arrays in the shared folder; the driver and the
Python workers hold one block at a time. With one block documents are read once, without a shuffle;
with several, each pass returns only the digests of the texts it hit, with what it hit, and these
are joined to the documents at the end.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import drop, free, written
from tessera.llm.textvec import ALNUM, U64, Texts, mix, slices

WINDOW = 10
#: words of benchmark items in a piece and, on average, in one automaton (about 60 MB in a worker)
PIECE, BLOCK_WORDS = 10_000, 100_000


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty string."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, words: list[int]) -> list[int]:
        """Add one sequence; the states of its prefixes."""
        last, states = 0, []
        for w in words:
            last = self._extend(last, w)
            states.append(last)
        return states

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the strings that reach it from p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


class Benchmark:
    """An automaton with what its states mean, as arrays. Words are their hashes.

    edge_from, edge_word, edge_to: transitions; link and length of states; state owner_state[i] ends
    a window of owner_n[i] words of item owner_item[i]; out: the first state on the way from a state
    along links, itself included, that ends a window, or 0; pairs: sorted hashes of neighbouring
    words; singles: of windows of one word; shortest: words of the shortest window.
    """

    ARRAYS = ("edge_from", "edge_word", "edge_to", "link", "length", "owner_state", "owner_n", "owner_item", "out", "pairs", "singles", "shortest")

    def __init__(self, arrays: dict[str, np.ndarray], item_ids: list[str]):
        self.__dict__.update(arrays)
        self.item_ids = item_ids
        self.maps: tuple | None = None

    def __getstate__(self) -> dict:
        return {**{k: getattr(self, k) for k in self.ARRAYS}, "item_ids": self.item_ids, "maps": None}

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, item_ids=np.array(self.item_ids, dtype=str), **{k: getattr(self, k) for k in self.ARRAYS})
        return held.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Benchmark:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        return Benchmark({k: held[k] for k in Benchmark.ARRAYS}, held["item_ids"].tolist())

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, end, item positions) of every window that occurs."""
        if self.maps is None:  # once a worker
            step = dict(zip(zip(self.edge_from.tolist(), self.edge_word.tolist(), strict=True), self.edge_to.tolist(), strict=True))
            ends: dict[int, dict[int, list[int]]] = {}
            for s, n, item in zip(self.owner_state.tolist(), self.owner_n.tolist(), self.owner_item.tolist(), strict=True):
                ends.setdefault(s, {}).setdefault(n, []).extend([item] if item >= 0 else [])
            self.maps = step, ends, self.link.tolist(), self.length.tolist(), self.out.tolist()
        step, ends, link, length, out = self.maps
        state = size = 0
        for end, w in enumerate(words, 1):
            while state and (state, w) not in step:
                state = link[state]
                size = length[state]
            if (state, w) in step:
                state = step[state, w]
                size += 1
            s = out[state]
            while s:
                for n, items in ends[s].items():
                    if n <= size:
                        yield end - n, end, items
                s = out[link[s]]


def build(items: list[tuple[str | None, list[int]]], window: int = WINDOW) -> Benchmark:
    """items: id as text and word hashes of items, or of pieces of items that overlap by a window less one."""
    a = Automaton()
    ids = sorted({i for i, _ in items if i is not None})
    place: dict[str | None, int] = {i: k for k, i in enumerate(ids)} | {None: -1}
    for _, words in items:
        a.add(words)
    owners: set[tuple[int, int, int]] = set()
    for item, words in items:
        n = min(window, len(words))
        state = size = 0
        for end, w in enumerate(words, 1):
            state, size = a.next[state][w], size + 1
            if end >= n:
                s = state
                while a.length[a.link[s]] >= n:
                    s = a.link[s]
                owners.add((s, n, place[item]))
    own = np.array(sorted(owners), dtype=np.int32).reshape(-1, 3)
    ending = set(own[:, 0].tolist())
    out = np.zeros(len(a.link), np.int32)
    for s in sorted(range(1, len(a.link)), key=a.length.__getitem__):  # links lead to shorter states
        out[s] = s if s in ending else out[a.link[s]]
    edges = [(s, w, to) for s, step in enumerate(a.next) for w, to in step.items()]
    pairs = [_pair(np.array(w[:-1], np.uint64), np.array(w[1:], np.uint64)) for _, w in items if len(w) > 1]
    arrays = {
        "edge_from": np.array([e[0] for e in edges], np.int32), "edge_word": np.array([e[1] for e in edges], np.uint64), "edge_to": np.array([e[2] for e in edges], np.int32),
        "link": np.array(a.link, np.int32), "length": np.array(a.length, np.int32), "owner_state": own[:, 0], "owner_n": own[:, 1], "owner_item": own[:, 2], "out": out,
        "pairs": np.unique(np.concatenate([*pairs, np.zeros(0, np.uint64)])), "singles": np.unique(np.array([x for _, w in items if min(window, len(w)) == 1 for x in w], np.uint64)),
        "shortest": np.array([min([window, *(len(w) for _, w in items if w)])]),
    }
    return Benchmark(arrays, ids)


def _known(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h


def _stretches(bench: Benchmark, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words in which a window may occur."""
    if not len(h):
        return []
    joined = np.zeros(len(h) + 1, bool)  # joined[i]: words i-1 and i belong together
    joined[1:-1] = (rows[1:] == rows[:-1]) & _known(bench.pairs, _pair(h[:-1], h[1:]))
    first = np.flatnonzero(~joined[:-1])
    end = np.flatnonzero(~joined[1:]) + 1
    least = max(2, int(bench.shortest[0])) if not len(bench.singles) else 1
    wanted = end - first >= least
    if least == 1:
        wanted &= (end - first > 1) | _known(bench.singles, h[first])
    return list(zip(first[wanted].tolist(), end[wanted].tolist(), strict=True))


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and where each row's begin."""
    starts, stops, rows = texts.tokens(ALNUM)
    return starts, stops, texts.hashes(starts, stops), np.searchsorted(rows, np.arange(texts.n + 1))


def _merge(spans: list[list[int]]) -> list[list[int]]:
    """Union of half-open spans: sorted, disjoint, not touching."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


Hits = dict[int, tuple[list[list[int]], set[str]]]


def _hits(bench: Benchmark, h: np.ndarray, begin: np.ndarray) -> Hits:
    """row -> (disjoint spans of words, ids of items), of the rows that a window hits."""
    found: dict[int, tuple[list[list[int]], set[str]]] = {}
    rows = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    for first, end in _stretches(bench, h, rows):
        row = int(rows[first])
        shift = first - int(begin[row])
        for b, e, items in bench.matches(h[first:end].tolist()):
            spans, ids = found.setdefault(row, ([], set()))
            spans.append([b + shift, e + shift])
            ids.update(bench.item_ids[i] for i in items)
    return {row: (_merge(spans), ids) for row, (spans, ids) in found.items()}


def _scan(held: object, emit: Callable[..., pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What emit makes of each run of rows, its words and its hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                starts, stops, h, begin = _words(texts)
                yield emit(part, texts, starts, stops, begin, _hits(held.value, h, begin))

    return run


def _join(names: list[str], emit: Callable[..., pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same of rows that carry the hits of several passes in the columns names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                starts, stops, _, begin = _words(texts)
                spans, items = (part.column(c).to_pylist() for c in names)
                hits = {i: (_merge([list(x) for y in s for x in y]), {x for y in items[i] for x in y}) for i, s in enumerate(spans) if s}
                yield emit(part.drop_columns(names), texts, starts, stops, begin, hits)

    return run


def _pieces(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, text) -> (item, words) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, h, begin = _words(Texts(part.column("text")))
                items, words = [], []
                for item, b, e in zip(part.column("item").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    for at in range(b, max(e - window + 1, b + (e > b)), PIECE):
                        items.append(item)
                        words.append(h[at : min(e, at + PIECE + window - 1)].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])

    return run


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, model: the automata of a benchmark (item_id, text), built in tasks, written."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    pieces = written(items.mapInArrow(_pieces(window), "item string, words array<long>").distinct(), "pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0

    def made(table: pa.Table) -> pa.Table:
        words = [np.asarray(x, np.int64).view(np.uint64).tolist() for x in table.column("words").to_pylist()]
        rows = sorted(zip(table.column("item").to_pylist(), words, strict=True), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        return pa.table({"block": table.column("block").slice(0, 1), "model": pa.array([build(rows, window).to_bytes()], pa.binary())})

    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, -(-total // block_words)))).cast("int")
    out = written(pieces.withColumn("block", block).groupBy("block").applyInArrow(made, "block int, model binary"), "automata")
    drop(pieces)
    return out


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, emit: Callable[..., pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What emit makes of all rows of docs (with a text column) and their hits."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    models = automata(benchmark, window, block_words)
    blocks = sorted(r.block for r in models.select("block").collect())
    load = lambda b: Benchmark.from_bytes(models.where(F.col("block") == b).first().model) if b is not None else build([], window)
    share = docs.sparkSession.sparkContext.broadcast
    if len(blocks) < 2:
        held = share(load(blocks[0] if blocks else None))
        drop(models)
        return docs.mapInArrow(_scan(held, emit), schema)
    names = free(docs, "text_digest", "hit_spans", "hit_items")

    def found(part: pa.RecordBatch, texts: Texts, starts: np.ndarray, stops: np.ndarray, begin: np.ndarray, hits: Hits) -> pa.RecordBatch:
        rows = sorted(hits)
        pair = pa.list_(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(rows, pa.int64())), pa.array([hits[i][0] for i in rows], pair), pa.array([sorted(hits[i][1]) for i in rows], pa.list_(pa.string()))], names=["digest", "spans", "items"])

    digest = F.unhex(F.md5("text"))
    all_hits, tables = None, []
    for b in blocks:
        held = share(load(b))
        hits = written(docs.select("text", digest.alias("digest")).mapInArrow(_scan(held, found), "digest binary, spans array<array<long>>, items array<string>").distinct(), "hits")
        held.destroy()
        tables.append(hits)
        all_hits = hits if all_hits is None else all_hits.unionByName(hits)
    drop(models)
    merged = all_hits.groupBy("digest").agg(F.collect_list("spans").alias(names[1]), F.collect_list("items").alias(names[2])).withColumnRenamed("digest", names[0])
    both = docs.withColumn(names[0], digest).join(merged, names[0], "left").drop(names[0])
    return both.mapInArrow(_join(names[1:], emit), schema)


def _counts(part: pa.RecordBatch, texts: Texts, starts: np.ndarray, stops: np.ndarray, begin: np.ndarray, hits: Hits) -> pa.RecordBatch:
    n = part.num_rows
    n_hit = [sum(e - b for b, e in hits[i][0]) if i in hits else 0 for i in range(n)]
    items = pa.array([sorted(hits[i][1]) if i in hits else [] for i in range(n)], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(begin).astype(np.int64)), pa.array(n_hit, pa.int64()), items], names=["doc_id", "n_words", "n_hit", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row for each row of docs.

    docs: doc_id, text; benchmark: item_id, text. Null texts have no words. Items of a null id count
    as hits but are not listed; items without words have no windows; rows that repeat an item
    change nothing. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit")), T.StructField("items", T.ArrayType(T.StringType()))])
    found = _marked(docs, benchmark, window, block_words, _counts, schema)
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the spans that windows cover; the columns of docs, n_chars brought up to date.

    A row goes where more than max_coverage of its words are hit, or nothing but white space is
    left; rows without a hit stay as they are. Columns may have any names.
    """

    def clean(part: pa.RecordBatch, texts: Texts, starts: np.ndarray, stops: np.ndarray, begin: np.ndarray, hits: Hits) -> pa.RecordBatch:
        left: dict[int, str] = {}
        gone = np.zeros(part.num_rows, bool)
        for i, (spans, _) in hits.items():
            at, end = int(texts.starts[i]), int(texts.ends[i])
            cuts = [at, *(int(x) for b, e in spans for x in (starts[begin[i] + b], stops[begin[i] + e - 1])), end]
            left[i] = b"".join(texts.raw[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode()
            gone[i] = sum(e - b for b, e in spans) > max_coverage * (begin[i + 1] - begin[i]) or not left[i].strip(" \t\n\v\f\r")
        columns = {c: part.column(c) for c in part.schema.names}
        if left:
            text = part.column("text").to_pylist()
            columns["text"] = pa.array([left.get(i, t) for i, t in enumerate(text)], part.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(left[i]) if i in left else n for i, n in enumerate(columns["n_chars"].to_pylist())]).cast(part.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(~gone))

    return _marked(docs, benchmark, window, block_words, clean, docs.withColumn("text", F.col("text").cast("string")).schema)
