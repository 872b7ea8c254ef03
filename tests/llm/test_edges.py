"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chunks, decontamination, html, lines, mixing, near_duplicates, neighbours, quality, registry, sql, toxicity, urls
from tests.differential import differences

R = random.Random(11)
VOCABULARY = ["".join(R.choice("aeioubcdfg") for _ in range(5)) for _ in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG, PASSAGE = prose(6000, 1), prose(70, 2)
A = prose(120, 3)
NEAR = " ".join([*A.split(" ")[:115], "x1", "x2", *A.split(" ")[117:]])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, size int, rep long, key string, a string, component string"
TEXTS = [(1, A), (2, A), (3, NEAR), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "One  two"), (9, LONG), (10, prose(80, 4) + "\n" + PASSAGE), (11, prose(90, 5) + "\n" + PASSAGE + "\n" + prose(30, 6)), (12, "é漢 ☃ 𝄞"), (13, "idiot " * 30), (13, "idiot " * 30), (None, A), (14, prose(60, 7))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 14 else f"s{(i or 0) % 3}", len(t or ""), 0.5, "h", 1, 2, "k", "a", "c") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in near_duplicates.near_duplicate_groups(docs).collect() if r.doc_id is not None}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 1, 1, 4, 5, 6, 7, 7, 9]
    assert [got[i].n_shingles for i in (4, 5, 6, 7)] == [0, 0, 0, 1] and got[1].kept and not got[2].kept
    nulls = near_duplicates.near_duplicate_groups(docs).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in nulls] == [(None, True)]
    assert near_duplicates.near_duplicate_groups(none).count() == 0


def test_chain_of_similar_texts_is_one_group(spark):
    words = prose(60, 8).split(" ")
    texts = [" ".join([f"n{k}x{i}" if i < k * 4 else w for i, w in enumerate(words)]) for k in range(4)]
    df = spark.createDataFrame([(10 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t.split(" ")[i : i + 5]) for i in range(56)} for t in texts]
    linked = [100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets, sets[1:], strict=False)]
    want, c = {}, None
    for k in range(4):
        c = 10 - k if k == 0 or not linked[k - 1] else c
        want.setdefault(c, []).append(10 - k)
    expected = {d: min(g) for g in want.values() for d in g}
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicate_groups(df).collect()} == expected


def test_rows_of_one_doc_id_are_one_document(spark):
    b = prose(90, 50)
    df = spark.createDataFrame([(3, b), (5, A), (5, b), (5, None), (9, NEAR), (11, prose(80, 51)), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicate_groups(df).where("doc_id IS NOT NULL").collect())
    assert got == [(3, 86, 3, True), (5, 0, 3, False), (5, 86, 3, False), (5, 116, 3, False), (9, 116, 3, False), (11, 76, 11, True)]


def test_edited_copies_are_grouped_as_by_brute_force(spark):
    """Copies of one text with random edits lie on both sides of the limit, so buckets hold several components."""
    r, base = random.Random(31), prose(150, 52).split(" ")
    texts = [" ".join(f"e{k}x{i}" if r.random() < r.choice((0.005, 0.02, 0.04)) else w for i, w in enumerate(base)) for k in range(60)]
    sets = [{tuple(t.split(" ")[i : i + 5]) for i in range(146)} for t in texts]
    group = list(range(60))
    pairs = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in range(60):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 2 < len(set(group)) < 50
    assert {x.doc_id: x.component_id for x in near_duplicates.near_duplicate_groups(df).collect()} == dict(enumerate(group))


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    total = sum(len((t or "").split()) for _, t in TEXTS)
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0) == (r.taken == 0 and r["size"] == 0)
        s = by_source.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] = max(s[3], r["size"])
    assert abs(sum(s[1] for s in by_source.values()) - total) < 1e-6
    assert all(s[1] <= 3 * s[2] + 1e-9 and abs(s[0] - s[1]) <= s[3] for s in by_source.values())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    assert mixing.mix(none).count() == 0


def test_targets_are_a_water_level(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (1.0, 2.0, 3.0), 3.0, 1.0).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got["a"] == got[None] == 730


def test_repeated_lines(docs, none):
    got = {(r.doc_id, r.source_doc_id) for r in lines.repeated_runs(docs).collect()}
    assert {(2, 1), (11, 10), (None, 1)} <= got and not any(d in (3, 7, 8, 9, 12, 14) for d, _ in got)
    kept = {(r.doc_id, r.text) for r in lines.drop_repeated_runs(docs).collect()}
    texts = dict(kept)
    assert 2 not in texts and PASSAGE not in texts[11] and PASSAGE in texts[10] and texts[9] == LONG
    assert texts[4] is None and texts[5] == "" and lines.drop_repeated_runs(docs).columns == docs.columns
    assert lines.repeated_runs(none).count() == 0 and lines.drop_repeated_runs(none).count() == 0


def test_stages_keep_columns_of_any_name(docs):
    names = "_runs _id _md5 _left line_runs run_doc_id run_text_md5 text_left seq words ahead gram b t".split()
    odd = docs.selectExpr("*", *[f"'keep {n}' AS {n}" for n in names])
    rows = lines.drop_repeated_runs(odd).collect()
    assert lines.drop_repeated_runs(odd).columns == odd.columns and all(r[n] == f"keep {n}" for r in rows for n in names)
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id or 0, r.text or "") for r in lines.drop_repeated_runs(docs).collect())


def test_lines_whose_middle_stands_earlier_elsewhere(spark):
    """Every line of every earlier run of 20 words is covered, wherever the first places of its parts are."""
    r, texts = random.Random(21), []
    for k in range(40):
        a, b, c = prose(12, 1000 + k), prose(30, 2000 + k), prose(13, 3000 + k)
        texts += [[prose(25, 4000 + k), b, prose(25, 5000 + k)], [prose(30, 6000 + k), a, b, c, prose(9, 7000 + k)], [prose(8, 8000 + k), a, b, c, prose(30, 9000 + k)]]
    common = [prose(r.randrange(2, 12), 10000 + k) for k in range(6)]
    texts += [[r.choice(common) for _ in range(r.randrange(2, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for s in range(len(t)):
            for e in range(s, len(t)):
                if len(" ".join(t[s : e + 1]).split()) >= 20:
                    run = tuple(t[s : e + 1])
                    if run in seen:
                        want.update((i, n) for n in range(s, e + 1))
                    seen.add(run)
    runs = lines.repeated_runs(df).collect()
    assert {(x.doc_id, n) for x in runs for n in range(x.first_line, x.last_line + 1)} == want
    for x in runs:
        n, there = x.last_line - x.first_line + 1, x.source_line_with_words - 1
        assert texts[x.doc_id][x.first_line : x.last_line + 1] == texts[x.source_doc_id][there : there + n]


def test_repeated_passages(docs, none):
    got = {(r.doc_id, r.source_doc_id) for r in chunks.repeated_passages(docs).collect()}
    assert {(2, 1), (3, 1), (11, 10)} <= got and not any(d in (1, 9, 10, 12, 14) for d, _ in got)
    assert chunks.repeated_passages(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split(" ")[:30]).upper()), (2, "one TWO"), (2, "one two"), (3, None), (None, "☃"), (4, "")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert (rows[10].n_hit, rows[10].n_items, rows[10].items_sha256) == (30, 1, hashlib.sha256(b"1").hexdigest())
    assert (rows[7].n_hit, rows[8].n_items) == (2, 1) and (rows[12].n_hit, rows[12].n_items) == (1, 0)
    assert rows[4].n_words == 0 and not rows[9].contaminated and rows[9].items_sha256 == hashlib.sha256(b"").hexdigest()
    small = {r.doc_id: tuple(r) for r in decontamination.contamination(docs, bench, block_words=7).collect()}
    assert small == {i: tuple(r) for i, r in rows.items()}
    left = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench).collect()}
    assert 7 not in left and left[9] == LONG and left[10].startswith(prose(80, 4)) and len(left[10].split()) == 120
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_in_several_full_blocks(spark, docs, monkeypatch):
    """Long items in overlapping pieces over several blocks give what one block gives, texts included."""
    items = [(1, LONG), (2, prose(900, 61)), (3, " ".join(PASSAGE.split(" ")[5:40])), (None, prose(50, 62)), (5, "idiot"), (5, "idiot")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(50 + k, prose(40, 70 + k) + " " + " ".join(LONG.split(" ")[k * 97 : k * 97 + 9 + k % 3]) + " .", "en", "s", 9, 0.0, "h", 1, 2, "k", "a", "c") for k in range(60)], SCHEMA))
    clashing = more.selectExpr("*", "1 AS _spans", "2 AS _items", "3 AS _left", "4 AS _b", "5 AS text_digest", "6 AS hit_spans", "7 AS hit_items")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    counts, clean = rows(decontamination.contamination(more, bench)), rows(decontamination.decontaminate(clashing, bench))
    assert sum(r[5] for r in counts) > 40 and len(clean) < len(counts)
    monkeypatch.setattr(decontamination, "PIECE", 200)
    assert decontamination.automata(bench, block_words=1500).count() > 3
    assert rows(decontamination.contamination(more, bench, block_words=1500)) == counts
    assert rows(decontamination.decontaminate(clashing, bench, block_words=1500)) == clean


def test_toxicity(spark, none):
    rows = [(i, prose(60, 100 + i) + (" you idiot moron " if i % 4 == 0 else " fine day "), i % 4 == 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 120] + [(None, 1), (5, None), (99999, 1)], "doc_id long, label int")
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, index).collect()}
    assert all((got[i].score >= 0.3) == y for i, _, y in rows)
    assert all(0 <= got[i].score < 0.3 and not got[i].neighbours for i in (900, 901, 902))
    assert toxicity.keep_clean(docs, index, 0.3).columns == docs.columns and toxicity.keep_clean(docs, index, 0.3).count() == 153
    assert toxicity.toxicity(none, toxicity.fit(none, labels)).count() == 0


def test_quality(spark, none):
    rows = [(i, prose(40, 300 + i) if i % 3 else prose(40, 300 + i).upper().replace(" ", "!! "), int(bool(i % 3))) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    w = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i < 140], "doc_id long, label int"))
    got = {r.doc_id: r.score for r in quality.quality(docs, w).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows) and got[900] == got[901]
    assert set(quality.fit(none, spark.createDataFrame([], "doc_id long, label int"))) == {0.0}


def test_classifiers_on_repeats_ties_long_texts_and_clashing_columns(spark):
    """Equal texts score alike wherever they stand, a repeated label row adds no example, and no column's name matters."""
    toxic, clean = prose(30, 90) + " you idiot moron", prose(30, 91) + " fine day"
    rows = [(i, prose(40, 400 + i) + (" you idiot moron" if i % 3 == 0 else " fine day")) for i in range(90)]
    rows += [(7, clean), (7, clean), (500, toxic), (501, toxic), (502, prose(30000, 92) + " you idiot moron idiot moron"), (None, toxic), (503, " \n"), (504, "é漢 ☃")]
    schema = "doc_id long, text string, label int, score double, neighbours string, cosines string, terms string, slots string, one string, size int, so_far int"
    docs = spark.createDataFrame([(i, t, 1, 0.5, "n", "c", "t", "s", "o", 1, 2) for i, t in rows], schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] * 2 + [(500, 1), (500, 0), (None, 1), (3, None), (4, 7)], "doc_id long, label int")
    index = toxicity.fit(docs, labels)
    assert len(index.keys) == 61 and len(set(index.keys.tolist())) == 61
    got = toxicity.toxicity(docs, index).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[501][0] == by_id[None][0] > 0.3 and min(by_id[7]) < 0.3 and by_id[503][0] == by_id[504][0] < by_id[501][0]
    assert all(500 not in r.neighbours for r in got if r.doc_id == 500)
    kept = toxicity.keep_clean(docs, index, 0.3)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {0.5}
    weights = quality.fit(docs, labels)
    scores = {}
    for r in quality.quality(docs, weights).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert scores[501] == scores[None] == scores[500] and scores[501][0] > scores[89][0] and len(scores[7]) == 3 and all(0 <= x <= 1 for s in scores.values() for x in s)


def test_main_text_of_clashing_columns_and_repeats(spark):
    page = "<article><p>One, two.</p></article>"
    pages = spark.createDataFrame([(1, "u", page, "t", 9), (1, "u", page, "t", 9), (None, None, page, "t", 9)], "page_id long, url string, html string, text string, n_chars int")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(pages).collect()] == [(1, "u", "One, two.", 9), (1, "u", "One, two.", 9), (None, None, "One, two.", 9)]


def test_urls(spark):
    rows = [(1, "HTTP://Www.Example.COM/en/7x?q"), (2, "http://a.b.com/en/1"), (3, "x"), (4, None), (5, "https://bad.org#x"), (6, "http://com/en/"), (7, "http://examplexcom/en/7"), (8, "http://bad.org/y"), (8, "http://bad.org/y"), (9, "://://e.org/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = spark.createDataFrame([(5, 1)] * 60 + [(2, 0)] * 60 + [(None, 1), (77, 1)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, bad, registry.URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("a.b.com", "/en/1", "com/en/", "block") and got[3] == ("", "", None, "allow") and got[4][:3] == ("", "", None)
    assert got[5] == ("bad.org", "", None, "block") and got[8][3] == "block" and got[6][2] == "com/en/" and got[7][2] is None and got[9][:2] == ("", "//e.org/es/") or got[9][0] == ":"
    assert urls.judge(pages.where("false"), bad, registry.URL_RULES).count() == 0
    d, s = urls.registered_domain("h")
    assert [tuple(r) for r in spark.createDataFrame([("a.b.co.uk",), ("x.com",), ("co.uk",), ("",)], "h string").select(d, s).collect()] == [("b.co.uk", "co.uk"), ("x.com", "com"), ("co.uk", "co.uk"), ("", "")]


def test_reputation_decides_verdicts_as_by_brute_force(spark):
    """Hosts of a bad domain are blocked with few outcomes or none, equal hosts of a good one aren't; a co.uk site is no domain of its neighbours."""
    hosts = {f"h{k}.bad.com": [1] * 4 for k in range(12)} | {"new.bad.com": []} | {f"h{k}.good.com": [0] * 4 for k in range(12)} | {"new.good.com": [], "one.good.com": [1]}
    hosts |= {"spam.co.uk": [1] * 12, "fine.co.uk": [0] * 12, "x.fine.co.uk": [], "": [0], "co.uk": []}
    rows, outcomes = [], []
    for host, bad in hosts.items():
        for b in [*bad, None]:
            rows.append((len(rows), f"http://{host}/p" if host else "no scheme", 7, "k", 0.5, 1.0))
            outcomes += [(len(rows) - 1, b)] if b is not None else []
    pages = spark.createDataFrame(rows, "page_id long, url string, host int, domain string, p double, bad double")
    got = {r.host: r.verdict for r in urls.judge(pages, spark.createDataFrame(outcomes, "page_id long, bad int"), []).collect()}

    def parts(host):
        labels = host.split(".")
        n = 2 if ".".join(labels[-2:]) in urls.SUFFIXES else 1
        return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])

    def strength(groups):  # (bad, n, p) of those with outcomes
        groups = [g for g in groups if g[1]]
        spread, noise, room = sum(n * (b / n - p) ** 2 for b, n, p in groups), sum(p * (1 - p) for _, _, p in groups), sum(p * (1 - p) * (n - 1) for _, n, p in groups)
        return 1 / min(max((spread - noise) / room if room else 0.001, 0.001), 0.5) - 1

    def level(keys, of, prior):
        count = {k: (sum(sum(b) for h, b in hosts.items() if of(h) == k), sum(len(b) for h, b in hosts.items() if of(h) == k), prior(k)) for k in keys}
        s = strength(count.values())
        return {k: ((b + s * p) / (n + s), n + s) for k, (b, n, p) in count.items()}

    every = [b for bad in hosts.values() for b in bad]
    suffixes = level({parts(h)[1] for h in hosts}, lambda h: parts(h)[1], lambda k: sum(every) / len(every))
    domains = level({parts(h) for h in hosts}, parts, lambda k: suffixes[k[1]][0])
    rates = level(set(hosts), lambda h: h, lambda k: domains[parts(k)][0])
    want = {h: "block" if m - urls.Z * (m * (1 - m) / (n + 1)) ** 0.5 > urls.LIMIT else "allow" for h, (m, n) in rates.items()}
    assert got == want
    assert got["new.bad.com"] == "block" == got["spam.co.uk"] and got["new.good.com"] == got["fine.co.uk"] == got["one.good.com"] == got["x.fine.co.uk"] == "allow"


def test_neighbours(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    rows[40] = (40, rows[20][1])
    odd = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (204, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for x in neighbours.nearest(df, k=20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert sorted(got) == [0, 20, 40, 60, 80, 100]
    for q, found in got.items():
        want = sorted(((sum(a * b for a, b in zip(v, rows[q][1], strict=True)), i) for i, v in rows if i != q), key=lambda x: (-x[0], x[1]))[:20]
        assert [v for _, v, _ in sorted(found)] == [i for _, i in want]
    few = neighbours.nearest(df.where("vec_id < 5"))
    assert few.count() == 4 and neighbours.nearest(df.where("false")).count() == 0


def test_neighbours_with_lists_left_out(spark):
    """End to end against brute force, on clustered vectors of which few lists are probed, and on random ones."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 32))
    clustered = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    for x, most in ((clustered, 0.35), (rng.normal(size=(6000, 32)), 0.95)):
        known = neighbours.fit(x, np.arange(6000), 6000, 20)
        assert len(known.centroids) > 50 and known.probes <= most * len(known.centroids)
        df = spark.createDataFrame(list(zip(range(6000), x.tolist(), ["c"] * 6000, range(6000), strict=True)), "vec_id long, embedding array<double>, floor string, home int")
        got = {}
        for r in neighbours.nearest(df, block=50).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        hits = 0
        for q in range(0, 6000, 20):
            product = x @ x[q]
            product[q] = -np.inf
            found = [v for _, v, _ in sorted(got[q])]
            assert len(found) == 20 and np.allclose([s for _, _, s in sorted(got[q])], product[found])
            hits += len(set(found) & set(np.argsort(-product)[:20].tolist()))
        assert hits >= 0.9 * 300 * 20


def test_neighbours_of_several_widths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 2.0, 2.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (2, [0.0, 3.0]), (0, [9.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, []), (5, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 0.5), (20, 1, 3, 5.0)]


def test_main_text(spark):
    pages = spark.createDataFrame([(1, None, "<p>Hello, world.</p>"), (2, "u", None), (2, "u", "")], "page_id long, url string, html string")
    assert [(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()] == [(1, "Hello, world.", 13), (2, "", 0), (2, "", 0)]
    assert html.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(sql.BY_QUERY))
def test_queries_are_their_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir) == ""


@pytest.mark.parametrize("name, column", [("op1_toxicity", "toxic"), ("op9_quality", "quality")])
def test_scores_hold_on_held_out_rows(spark, name, column):
    folder = "/root/testdata/sf0.01"
    scored = registry.queries()[name](spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", F.col(column).alias("y")).collect()
    assert sum(r.predicted == r.y for r in rows) >= 0.93 * len(rows)


def test_pipeline_stages_do_their_work(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        assert 0.5 * before < docs.count() <= before
    assert docs.where("taken > 3 * size").count() == 0
    near = near_duplicates.near_duplicate_groups(spark.read.parquet(str(tmp_path / "2")))
    assert near.where("NOT kept").count() == 0
    clean = decontamination.contamination(spark.read.parquet(str(tmp_path / "3")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert clean.where("contaminated").count() == 0
