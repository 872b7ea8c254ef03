"""Queries that SQL can't express, against plain Python over whole tables."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import registry, toxicity

TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def ascii_lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def rows_of(sf_dir, name):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").df()


def terms(text):
    return Counter(TERM.findall(ascii_lower(text or "")))


def test_toxicity_query(spark, sf_dir):
    docs, labels = rows_of(sf_dir, "documents"), rows_of(sf_dir, "labels")
    texts = dict(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    known = {int(i): int(y) for i, y in zip(labels.doc_id, labels.toxic, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2}
    examples = {i: terms(texts[i]) for i in known if i in texts}
    assert len(examples) < toxicity.EXAMPLES_PER_LABEL
    df = Counter(w for t in texts.values() for w in terms(t))
    n = [sum(known[i] == y for i in examples) for y in (0, 1)]
    held = [Counter(w for i, t in examples.items() if known[i] == y for w in t) for y in (0, 1)]

    def gain(w):
        b, a = held[0][w], held[1][w]
        chi = max(abs(a * (n[0] - b) - b * (n[1] - a)) - sum(n) / 2, 0) ** 2 * sum(n) / max((a + b) * max(sum(n) - a - b, 1) * max(n[0], 1) * max(n[1], 1), 1)
        return math.log1p(len(docs) / df[w]) * (toxicity.FLOOR + (1 - toxicity.FLOOR) * chi**4 / (chi**4 + toxicity.DOUBT**4))

    gains = {w: gain(w) for w in held[0] | held[1]}

    def vector(t, own=None):
        """Of a query: without the terms that only its own example holds."""
        v = {w: (1 + math.log(c)) * gains[w] for w, c in t.items() if w in gains and (own not in examples or w not in examples[own] or held[0][w] + held[1][w] > 1)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(t) for i, t in examples.items()}

    def nearest(own, v):
        found = sorted((-round(sum(x * e.get(w, 0.0) for w, x in v.items()), 11), i) for i, e in vectors.items() if i != own)
        return [(i, -c) for c, i in found[: toxicity.NEIGHBOURS] if c < 0]

    def evidence(found):
        if not found:
            return [1.0, 0.0, 0.0, 0.0]
        votes = [0.0, 0.0]
        for i, c in found:
            votes[known[i]] += 1 / (1.05 - min(c, 1))
        return [1.0, math.log((votes[1] + 0.5) / (votes[0] + 0.5)), found[0][1], 1.0]

    curve = toxicity._fit_curve(np.array([evidence(nearest(i, vector(t, i))) for i, t in examples.items()]), np.array([known[i] for i in examples], float))
    base = sum(known.values()) / len(known)
    got = {r.doc_id: r for r in registry.op1_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in texts.items():
        found = nearest(i, vector(terms(text), i))
        assert got[i].cosines == pytest.approx([c for _, c in found], abs=1e-9)
        z = np.dot(evidence(found), curve) + math.log(base / (1 - base))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and i not in got[i].neighbours
        assert got[i].predicted == int(got[i].score >= 0.3)


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Each stage's rows from its own input: scores, SQL of the operators over that input, and plain Python."""
    import corpus_pipeline
    from tessera.llm import sql

    con = duckdb.connect()
    for t in ("labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = rows_of(sf_dir, "documents")
    toxic = {r.doc_id for r in registry.op1_toxicity(spark, sf_dir).where("predicted = 1").collect()}

    def lines_left(found):
        runs = {}
        for r in con.execute(sql.REPEATED_LINES).fetchall():
            runs.setdefault(r[0], set()).update(range(r[1], r[2] + 1))
        for i, text in found.items():
            kept = text if i not in runs else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in runs[i])
            if i not in runs or kept.split():
                yield i, kept

    def clean(found):
        hits = {r[0]: r for r in con.execute(f"SELECT doc_id, n_words, n_hit FROM ({sql.DECONTAMINATION}) WHERE contaminated").fetchall()}
        return {i: None if i in hits else text for i, text in found.items() if i not in hits or hits[i][2] <= 0.5 * hits[i][1]}

    expected = [
        lambda found: {i: t for i, t in found.items() if i not in toxic},
        lambda found: dict(lines_left(found)),
        lambda found: {r[0]: found[r[0]] for r in con.execute(f"SELECT doc_id FROM ({sql.NEAR_DUPLICATES}) WHERE kept").fetchall()},
        clean,
    ]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        con.execute("CREATE OR REPLACE TABLE documents AS SELECT * FROM before")
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = duckdb.sql(f"SELECT * FROM '{tmp_path / str(k)}/*.parquet'").df()
        if k < 4:
            want = expected[k](dict(zip(before.doc_id.tolist(), before.text.tolist(), strict=True)))
            got = dict(zip(after.doc_id.tolist(), after.text.tolist(), strict=True))
            assert set(got) == set(want) and len(after) == len(got)
            assert all(t is None or got[i] == t for i, t in want.items())
            assert all(len(t) == n for t, n in zip(after.text, after.n_chars, strict=True))
        else:
            want = con.execute(sql.MIXING).fetchall()
            got = sorted(tuple(r) for r in docs.select("doc_id", "size", "source_size", "target", "taken").collect())
            assert [(r[0], r[1], r[2], r[4]) for r in got] == sorted((r[0], r[1], r[2], r[4]) for r in want)
            assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)])
        before = after


def test_repeated_passages_are_found_and_real(spark):
    """Against plain Python: every planted passage of 50 words is found, and all that is reported stands elsewhere too."""
    import random

    from tessera.llm import chunks

    r = random.Random(17)
    words = lambda n: " ".join(r.choice("aeiou") * r.randrange(1, 3) + r.choice("bcdfg") + str(r.randrange(400)) for _ in range(n))
    passages = [words(50 + k % 3) for k in range(60)]
    texts = [(k, f"{words(r.randrange(60))} {p} {words(r.randrange(60))}".strip()) for k, p in enumerate(passages * 2)]
    texts += [(200, words(80)), (201, ""), (202, None), (None, words(5) + " " + passages[0]), (None, passages[1]), (203, passages[2]), (203, passages[2]), (203, words(9) + " " + passages[3]), (204, "x " + passages[4] + " y " + passages[4])]
    df = spark.createDataFrame([(i, t, 1, "d") for i, t in texts], "doc_id long, text string, chunk int, digest string")
    rows = chunks.repeated_passages(df).collect()
    covered = {}
    for x in rows:
        at = [t for i, t in texts if i == x.doc_id and t and x.n_words == len(t[x.first_char : x.first_char + x.n_chars].split()) and sum(t[x.first_char : x.first_char + x.n_chars] in (u or "") for _, u in set(texts)) + (t.count(t[x.first_char : x.first_char + x.n_chars]) > 1) > 1]
        assert at, x
        covered.setdefault(x.doc_id, []).append(x)
    assert {60 + k for k in range(60)} <= set(covered) and {None, 203, 204} <= set(covered)
    assert not {k for k in range(60)} & set(covered) and not {200, 201, 202} & set(covered)
    for k in range(60):
        text = dict(texts[60:120])[60 + k]
        start = text.index(passages[k])
        assert any(x.first_char < start + len(passages[k]) and x.first_char + x.n_chars > start and x.source_doc_id == k for x in covered[60 + k])
    assert len(covered[204]) == 2 and len(covered[203]) == 2 and {x.n_words for x in covered[203]} <= set(range(20, 53))


def test_quality_scores_are_the_dot_products(spark, sf_dir):
    """Scores of the query from its weights by plain Python, and the weights by a plain follow-the-regularised-leader."""
    import pyarrow as pa

    from tessera.llm import quality, toxicity
    from tessera.llm.textvec import Texts, mix

    docs, labels = rows_of(sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    picked = toxicity.training_labels(labels, "quality", 5, 0, held=False)
    known = {r.doc_id: int(r.label) for r in picked.collect() if r.label in (0, 1)}
    texts = dict(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))

    def shares(text):
        _, slots = quality.features(Texts(pa.array([text], pa.string())))
        return {s: quality.SCALE * n / len(slots) for s, n in Counter(slots.tolist()).items()}

    z, n = Counter(), Counter()
    bias = 1 << quality.BITS

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.5 else -(z[i] - math.copysign(0.5, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 0.5)

    def sigmoid(x):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    ids = np.array(sorted(i for i in known if i in texts))
    order = ids[np.argsort(mix(ids.astype(np.int64).view(np.uint64)), kind="stable")].tolist()
    rows = {i: {s: float(np.float32(v)) for s, v in shares(texts[i]).items()} | {bias: 1.0} for i in order}
    for _ in range(quality.EPOCHS):
        for i in order:
            w = {s: weight(s) for s in rows[i]}
            p = sigmoid(sum(w[s] * x for s, x in rows[i].items()))
            for s, x in rows[i].items():
                g = (p - known[i]) * x
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / 0.3 * w[s]
                n[s] += g * g
    got = {r.doc_id: r.score for r in registry.op9_quality(spark, sf_dir).collect()}
    for i, text in texts.items():
        assert got[i] == pytest.approx(sigmoid(sum(weight(s) * x for s, x in shares(text).items()) + weight(bias)), abs=1e-6)
