"""Kernels of the training-data operators against plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chunks, decontamination, html, neighbours, quality, toxicity
from tessera.llm.near_duplicates import superminhash
from tessera.llm.textvec import ALNUM, NON_SPACE, Texts, grams, shingle_sets, slices

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="abAB é\n\t .|漢", max_size=60)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_tokens_are_the_regular_expressions(rows):
    t = Texts(pa.array(rows, pa.string()))
    for classes, pattern in ((NON_SPACE, SPACE), (ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))):
        starts, stops, at = t.tokens(classes)
        got = [(int(r), bytes(t.raw[a:b]).decode()) for a, b, r in zip(starts, stops, at, strict=True)]
        assert got == [(i, w) for i, r in enumerate(rows) for w in pattern.findall(r or "")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_shingle_sets(rows):
    h, first, last = shingle_sets(Texts(pa.array(rows, pa.string())))
    sets = []
    for r in rows:
        w = [lower(x) for x in SPACE.findall(r or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    assert [int(n) for n in last - first] == [len(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(h[first[i] : last[i]], h[first[j] : last[j]])) == len(a & b)


def test_sliced_columns_keep_their_rows():
    column = pa.array(["one two", None, "three", "", "four five six"]).slice(1, 4)
    t = Texts(column)
    assert [int(r) for r in t.tokens()[2]] == [1, 3, 3, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, ""])], names=["text"])
    assert [p.num_rows for p in slices(batch, "text", 20)] == [2, 1, 1]
    assert sum(p.num_rows for p in slices(batch, "text", 1)) == 4


def plain_superminhash(h, slots):
    """The definition: element by element, level by level."""
    from tessera.llm.near_duplicates import _draws

    sig = [math.inf] * slots
    for x in h:
        perm = list(range(slots))
        for level in range(slots):
            v, k = _draws(np.array([x], np.uint64), level, slots)
            perm[level], perm[k[0]] = perm[k[0]], perm[level]
            sig[perm[level]] = min(sig[perm[level]], v[0])
    return sig


def test_superminhash_with_early_stop_is_the_definition():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 0, 40, 400]
    h = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    last = np.cumsum(sizes)
    got = superminhash(h, last - sizes, last, 24)
    for i, n in enumerate(sizes):
        assert list(got[i]) == plain_superminhash(h[last[i] - n : last[i]], 24)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (300, 50, 50))
    h = np.concatenate([both, a, both, b])
    sig = superminhash(h, np.array([0, 350]), np.array([350, 700]), 256)
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.08


WORD = st.sampled_from("abcd")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(WORD, max_size=9), min_size=1, max_size=4), st.lists(WORD, max_size=30), st.integers(1, 4))
def test_automaton_finds_what_brute_force_finds(items, doc, window):
    hashed = lambda w: [int(x) for x in Texts(pa.array([" ".join(w)])).hashes(*Texts(pa.array([" ".join(w)])).tokens(ALNUM)[:2])]
    bench = decontamination.Benchmark.from_bytes(decontamination.build([(str(i), hashed(w)) for i, w in enumerate(items)], window).to_bytes())
    hit, found = set(), set()
    for i, w in enumerate(items):
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    t = Texts(pa.array([" ".join(doc)]))
    starts, stops, rows = t.tokens(ALNUM)
    h = t.hashes(starts, stops)
    got_hit, got = set(), set()
    for first, end in decontamination._stretches(bench, h, rows):
        for b, e, ids in bench.matches(h[first:end].tolist()):
            got_hit.update(range(b + first, e + first))
            got.update(bench.item_ids[i] for i in ids)
    assert (got_hit, got) == (hit, found)


def test_gear_hash_is_the_rolling_one():
    raw = np.frombuffer(random.Random(3).randbytes(200), np.uint8)
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear(raw).tolist() == want


def test_gear_hash_of_a_span_is_rolled_over_it_alone():
    raw = np.frombuffer(random.Random(4).randbytes(300), np.uint8)
    h = chunks.gear(raw)
    for start, stop in ((0, 1), (0, 31), (0, 50), (7, 8), (9, 40), (9, 41), (100, 300), (33, 64)):
        assert chunks.gear_of(h, np.array([start]), np.array([stop]))[0] == chunks.gear(raw[start:stop])[-1]


def test_chunks_cover_the_rows_and_resist_insertions():
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randrange(99)) for _ in range(600))
    t = Texts(pa.array([text, "", "inserted " + text]))
    rows, starts, stops = chunks.cut(t)
    assert [int((stops - starts)[rows == i].sum()) for i in (0, 1, 2)] == [len(text), 0, len(text) + 9]
    d = t.hashes(starts, stops, lower=False)
    a, b = set(d[rows == 0].tolist()), set(d[rows == 2].tolist())
    assert len(a & b) >= len(a) - 3


def test_repeated_chunks_of_any_passage_of_50_words_hold_20():
    rng = random.Random(8)
    words = lambda n: [rng.choice("aeiou") * rng.randrange(1, 4) + rng.choice("bcdfg") + str(rng.randrange(30)) for _ in range(n)]
    for n in (50, 51, 60, 90):
        for _ in range(150):
            passage = words(n)
            t = Texts(pa.array([" ".join(words(rng.randrange(40)) + passage + words(rng.randrange(40))) for _ in range(2)]))
            rows, starts, stops = chunks.cut(t)
            d = t.hashes(starts, stops, lower=False)
            again = np.isin(d, d[rows == 0]) & (rows == 1)
            assert sum(len(bytes(t.raw[a:b]).split()) for a, b in zip(starts[again], stops[again], strict=True)) >= 20


def examples(rng, n, vocabulary):
    """Ten subjects with words of their own, and some words of any."""
    rows, h, tf = [], [], []
    for i in range(n):
        own = vocabulary[i % 10 :: 10]
        t = np.unique(np.append(rng.choice(own, rng.integers(1, 12), replace=False), rng.choice(vocabulary, 2)))
        rows.append(np.full(len(t), i))
        h.append(t)
        tf.append(rng.integers(1, 4, len(t)))
    return np.concatenate(rows), np.concatenate(h).astype(np.uint64), np.concatenate(tf)


def test_block_max_search_is_exact_and_reads_less():
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(1, 2**62, 900)
    rows, h, tf = examples(rng, 1500, vocabulary)
    frequency = np.sort(vocabulary).astype(np.uint64), rng.integers(1, 400, len(vocabulary))
    index = toxicity.build(np.arange(1500), np.arange(1500) % 3 == 0, rows, h, tf, frequency, 1000, 0.3)
    dense = np.zeros((1500, len(index.terms)))
    for i in range(1500):
        t, w = index.vector(h[rows == i], tf[rows == i])
        dense[i, t] = w
    read = [0, 0]
    for i in range(0, 1500, 25):
        t = np.flatnonzero(dense[i])
        for without in (-1, int(np.flatnonzero(index.keys == i)[0])):
            ids, cos = index.nearest(t, dense[i, t], 15, without, read)
            full = np.round(dense @ dense[i], 12)
            if without >= 0:
                full[i] = -1
            want = np.lexsort((np.arange(1500), -full))[:15]
            want = want[full[want] > 0]
            assert np.allclose(cos, full[want], atol=1e-11)
            sure = full[want] > full[want[-1]] + 1e-9
            assert set(index.keys[ids].tolist()) >= set(want[sure].tolist())
    assert read[0] < 0.7 * read[1]


def test_a_query_without_known_terms_has_no_neighbours():
    none = np.zeros(0, np.int64)
    index = toxicity.build(none, none, none, none.astype(np.uint64), none, (none.astype(np.uint64), none), 0, 0.1)
    ids, cos = index.nearest(np.zeros(0, np.int64), np.zeros(0), 5)
    assert not len(ids) and 0 <= toxicity.score(index, ids, cos) <= 1
    assert not len(index.vector(np.array([5], np.uint64), np.array([1]))[0])


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(6)
    rows, y = [], []
    for i in range(400):
        label = i % 2
        slots = np.unique(np.append(rng.integers(10, 1000, 20), 1 if label else 2))
        rows.append((slots, np.full(len(slots), 0.5)))
        y.append(label)
    w = quality.train(rows, np.array(y, float), bits=10)
    z = np.array([w[s] @ v + w[-1] for s, v in rows])
    assert (((z > 0) == (np.array(y) == 1)).mean()) > 0.97
    assert (w == 0).mean() > 0.3


def test_adaptive_scan_keeps_the_nearest_and_reads_less():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x[5:40] = x[4]  # ties
    ids, asking, read = np.arange(6000), np.arange(0, 200, 10), [0, 0]
    product = x[asking] @ x.T
    product[np.arange(20), asking] = -np.inf
    floor = np.sort(product[:, :1500], axis=1)[:, -20]  # as a sample says
    q, found, score = neighbours.scan(x, ids, x[asking], asking, floor, 20, neighbours.rotation(64), read)
    hits = 0
    for n, i in enumerate(asking):
        want = np.lexsort((ids, -np.round(product[n], 9)))[:20]
        hits += len(set(found[q == i].tolist()) & set(want.tolist()))
        assert np.allclose(score[q == i], product[n][found[q == i]]) and (np.diff(score[q == i]) <= 0).all()
    assert hits >= 0.96 * 400
    assert read[0] <= 0.65 * read[1]


def test_scan_without_floor_or_with_few_candidates():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 5))
    none = np.full(30, -np.inf)
    q, found, score = neighbours.scan(x, np.arange(30), x, np.arange(30), none, 50, neighbours.rotation(5))
    assert len(q) == 30 * 29 and not (q == found).any() and np.allclose(score, (x[q] * x[found]).sum(1))
    assert all(len(a) == 0 for a in neighbours.scan(x[:0], np.arange(0), x, np.arange(30), none, 5, neighbours.rotation(5)))


PAGE = """<html><head><title>T</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and so on, and so on.</p></div>
<article><h1>On&nbsp;tea &amp; time</h1><p>Tea is old.   It was drunk
long ago, they say, by many. <b>Truly</b>, it was.<p>Second part: short.</p><div class="ad">Buy now. Buy, buy, buy!</div>
<blockquote>&#x201C;A cup, please.&#8221;</blockquote></article>
<section id="comments"><p>First! I liked this, a lot, really, yes.</p></section><aside>More, more, more.</aside>
<footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "On tea & time\nTea is old. It was drunk long ago, they say, by many. Truly, it was.\nSecond part: short.\n“A cup, please.”"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a>x</a></nav>") == ""
    assert html.main_text("plain words, no markup.") == "plain words, no markup."


PLAIN = """<html><body><div id="top"><div><a href=x>Home</a> <a href=y>World</a> <a href=z>Sport</a></div></div>
<div class="story"><h2>Rain again</h2><div class="market-share">Shares, it seems, fell; then they rose, and fell again.</div><p class="market-share">It rained, and rained; nobody, they said, was dry.</p>
<p><a href=q>The whole report, with tables, can be read here.</a></p><p>On Monday, the sun is due, perhaps.</p></div>
<div id="links"><ul><li><a href=1>Ten best umbrellas</a><li><a href=2>Ten worst boots</a><li><a href=3>More</a></ul></div></body></html>"""


def test_main_text_without_article_is_decided_by_ratios():
    """The link lists have no telling tag or name; their ratio alone leaves them out, and the story's container its headings in."""
    got = html.main_text(PLAIN).split("\n")
    assert got[0] == "Rain again" and got[-1] == "On Monday, the sun is due, perhaps."
    assert "Shares, it seems, fell; then they rose, and fell again." in got and "It rained, and rained; nobody, they said, was dry." in got
    assert not any(x in " ".join(got) for x in ("Home", "umbrellas", "boots"))
    article = html.main_text(PLAIN.replace('<div class="story">', "<article>").replace('</div>\n<div id="links">', '</article>\n<div id="links">'))
    assert "The whole report, with tables, can be read here." in article.split("\n")


def test_main_text_takes_time_in_proportion():
    import time

    words = "Some words, and more. "
    forms = {"inline": lambda n: "<p>" + "<b>x</b> y " * n, "unclosed": lambda n: "<a " * n, "nested": lambda n: "<div>x" * n, "quotes": lambda n: "<p>it's <a b='" * n, "paragraphs": lambda n: "<p>" + words + "<b>" * 3 + "<li>" * (n // 5), "inside": lambda n: "<b>" * n + "<p>x</p>" * n}
    for name, make in forms.items():
        small, large = make(1000), make(8000)
        t0 = time.process_time()
        html.main_text(small)
        t1 = time.process_time()
        html.main_text(large)
        t2 = time.process_time()
        assert t2 - t1 < 24 * (t1 - t0) + 0.3, name


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/\"'=apdivnscrt& ;#x!-", max_size=80))
def test_main_text_never_fails(page):
    assert isinstance(html.main_text(page), str)


def test_word_grams_stay_inside_rows():
    t = Texts(pa.array(["a b c", "d e"]))
    s, e, r = t.tokens()
    assert grams(t.hashes(s, e), r, 3)[1].tolist() == [0]


def test_wide_index_finds_the_same():
    texts = Texts(pa.array(["bad fool words", "good words here", "bad bad fool", "plain good text here"]))
    rows, h, tf = toxicity.distinct_terms(texts)
    index = toxicity.build([1, 2, 3, 4], [1, 0, 1, 0], rows, h, tf, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 4, 0.5)
    wide = index.widened()
    assert {getattr(wide, n).dtype for n in ("first", "block", "start", "ids")} == {np.dtype(np.intp)}
    for i in range(4):
        mine = rows == i
        a, b = (x.nearest(*x.vector(h[mine], tf[mine]), 3) for x in (index, wide))
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
