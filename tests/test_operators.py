"""Operators on small frames: properties, edges, and behaviours that the tables don't show."""

from pyspark.sql import functions as F

from tessera.operators import graphs, labels, linking, metrics, ordered, rules


def test_islands_cover_their_input_once(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 2, 3, 7, 9, 10)] + [(2, 5)], "k int, v int")
    got = sorted(tuple(r) for r in ordered.islands(df, ["k"], "v").collect())
    assert got == [(1, 1, 3), (1, 7, 7), (1, 9, 10), (2, 5, 5)]


def test_balanced_scan_without_return(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate("})({}x{")], "k string, at int, c string")
    row = ordered.balanced_scan(df, ["k"], "at", F.col("c") == "{", F.col("c") == "}").first()
    assert (row.opened_at, row.closed_at) == (3, 4)


def test_resume_without_done_rows_keeps_all(spark):
    df = spark.range(5)
    assert ordered.resume_after(df, ["id"], F.col("id") == 99).count() == 5
    assert [r.id for r in ordered.resume_after(df, ["id"], F.col("id") == 2).orderBy("id").collect()] == [3, 4]


def test_upsert_keeps_attributes_that_later_edges_leave_null(spark):
    df = spark.createDataFrame([(1, 2, 0, "cf", "cf_true"), (1, 2, 1, "df", None)], "src int, dst int, o int, edge_type string, sub string")
    row = graphs.upsert_edges(df, ["src", "dst"], ["o"], ["edge_type", "sub"]).first()
    assert (row.edge_type, row.sub) == ("df", "cf_true")


def test_contiguous_ids_are_the_row_numbers(spark):
    df = spark.createDataFrame([(int(x),) for x in (5, 3, 99, 7, 1, 50)], "v long")
    got = {r.v: r.i for r in graphs.contiguous_ids(df, ["v"], "i", ranges=3).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_closure_is_transitive_and_idempotent(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 1)], "src long, dst long")
    once = graphs.closure(edges)
    pairs = {tuple(r) for r in once.collect()}
    assert {(a, d) for a, b in pairs for c, d in pairs if b == c} <= pairs
    assert {tuple(r) for r in graphs.closure(once).collect()} == pairs


def test_induced_edges_are_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([("g", 1)], "graph string, node long")
    members = graphs.khop(seeds, edges, "graph", "node", 2)
    assert sorted(r.node for r in members.collect()) == [1, 2, 3]
    assert sorted((r.src, r.dst) for r in graphs.induced(members, edges, "graph", "node").collect()) == [(1, 2), (2, 3)]


def test_split_gives_each_label_of_three_rows_all_parts(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(60)], "k long, y int")
    out = labels.stratified_split(df, "y", "k", 1)
    assert out.count() == 60
    assert {(r.y, r.split) for r in out.select("y", "split").distinct().collect()} == {(y, s) for y in (0, 1) for s in ("train", "validation", "test")}


def test_def_use_pairs_are_strictly_earlier(spark):
    df = spark.createDataFrame([("f", "x", 0, 10), ("f", "x", 2, 12)], "f string, v string, pos int, node int")
    uses = spark.createDataFrame([("f", "x", 1, 11), ("f", "x", 2, 12), ("f", "x", 0, 9)], "f string, v string, pos int, node int")
    got = sorted((r["def"], r.use) for r in linking.def_use(df, uses, ["f", "v"], "pos", "node").collect())
    assert got == [(10, 11), (10, 12)]


def test_exact_calls_hide_the_others(spark):
    sites = spark.createDataFrame([(1, "f", "uint"), (2, "g", "bool")], "site int, name string, sa string")
    defs = spark.createDataFrame([("f", "uint", 7), ("f", "bool", 8), ("g", "uint", 9), ("g", "", 10)], "name string, a string, node int")
    got = sorted((r.site, r.node) for r in linking.resolve_calls(sites, defs, ["site"], ["name"], "sa", "a").collect())
    assert got == [(1, 7), (2, 9), (2, 10)]


def test_needles_are_found_at_cut_words_and_short(spark):
    texts = spark.createDataFrame([(1, "xa b c d e fz and more"), (2, "a b"), (3, None)], "t long, text string")
    needles = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (3, "q r s t u v")], "n long, needle string")
    got = sorted((r.t, r.n) for r in linking.contains_matches(texts, needles, "text", "needle").collect())
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_auc_counts_ties_half_and_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert metrics.roc_auc(df, F.col("y"), "p").first().auc == 0.875
    assert metrics.roc_auc(df.where("y = 1"), F.col("y"), "p").first().auc == 0.5


def test_sweep_without_positives(spark):
    df = spark.createDataFrame([("a", 0, 0.9), ("b", 1, 0.3), ("b", 0, 0.1)], "c string, y int, p double")
    got = {r.c: r.threshold for r in metrics.best_class_thresholds(df, "c", "y", "p", [0.1, 0.2, 0.3]).collect()}
    assert got == {"a": 0.9, "b": 0.2}


def test_ledger_pending(spark):
    ledger = spark.createDataFrame([("p", "a", 1, 1), ("p", "b", -1, 1), ("q", "a", 1, 1), ("q", "a", 0, 2)], "project string, step string, status int, at int")
    last = rules.ledger_latest(ledger, ["project", "step"], ["at"])
    show = lambda retry: sorted((r.project, r.step) for r in rules.pending(ledger, ["a", "b"], last, "project", retry).collect())
    assert show(True) == [("p", "b"), ("q", "a"), ("q", "b")]
    assert show(False) == [("q", "a"), ("q", "b")]


def test_line_ranges_and_signatures(spark):
    df = spark.createDataFrame([("L12-L15",), ("7",), ("L12345678",)], "t string")
    a, b = rules.line_range(F.col("t"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("12", "15"), ("7", "7"), ("invalid", "invalid")]
    sig = spark.createDataFrame([("move(address to, uint256 n)",), ("idle()",), ("bare",)], "t string")
    assert [tuple(r) for r in sig.select(*rules.signature(F.col("t"))).collect()] == [("move", "address,uint256"), ("idle", ""), ("bare", "")]


def test_only_single_lines_are_invalid_by_length(spark):
    df = spark.createDataFrame([("L10000000-l20000000",), (" L1 - L2\t",), ("1-2-3",), ("12345678-2-3",), ("123456789",), ("",), ("5-",), (None,)], "t string")
    want = [("10000000", "20000000"), ("1", "2"), ("1", "1"), ("invalid", "invalid"), ("invalid", "invalid"), ("", ""), ("5", ""), (None, None)]
    assert [tuple(r) for r in df.select(*rules.line_range(F.col("t"))).collect()] == want


def test_line_range_query_on_large_keys(spark, tmp_path):
    from tessera.plans import catalogue
    from tests.differential import differences

    rows = [(1, 1), (99999, 9999), (100000, 10000), (5999999, 89999), (7, 123456789), (8, None), (None, 8)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert differences(catalogue.queries()["line_range_parse"](spark, str(tmp_path)), catalogue.oracle_sql()["line_range_parse"], str(tmp_path)) == ""


def test_text_embedding_reads_whole_documents(spark, tmp_path):
    from tessera.plans import catalogue

    texts = [(1, "first line\nsecond one"), (2, "first line"), (3, "One second, line first"), (4, None)]
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame(texts, f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.doc_id: r.vector for r in catalogue.queries()["text_embedding"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1] == got[3] != got[2]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in got.values())
