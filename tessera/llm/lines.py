"""Repeated runs of lines by winnowing over line hashes, on DataFrame operations alone.

A line is what stands between line feeds; lines without words are passed over. The gram of a line
is the shortest run of whole lines from it that holds min_words words. Winnowing: of every such run
the line of the least hash is selected, so equal stretches of text select equal lines; the gram of
a selected line is a fingerprint. Any line of min_words words is its own fingerprint, and so a
repeated one is always found; a repeated run of shorter lines is found if it holds a selected line
with its gram, for certain once it has four times min_words words.

Each fingerprint is joined to its first place in the table, by (doc_id, text, line), and a match
with an earlier place is extended line by line both ways as far as the two texts agree. The lines
covered are a later repeated run. Ties between equal hashes go to the earlier line.

The first place of a fingerprint may agree with less of a text than another earlier place. So the
shortest runs of min_words words from every line on and up to every line are joined to their first
places too, and those that hold a line not covered above are later repeated runs as well. A repeated
run of min_words words is made of such shortest runs, so none of its lines is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.mixing import word_count
from tessera.llm.tables import free, written

MIN_WORDS = 20


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5, line (from 0), seq (from 1, among lines with words), h, words, ahead."""
    key = ["doc_id", "text_md5"]
    # the digest of a text is taken once, before its lines are dealt out
    whole = docs.select("doc_id", F.md5(F.col("text").cast("string")).alias("text_md5"), F.split("text", "\n").alias("parts"))
    split = whole.select(*key, F.posexplode("parts").alias("line", "content")).where(F.col("content").rlike(r"[^\x20\x09-\x0D]"))
    # rows that repeat a doc_id and its text are one text
    lines = split.select(*key, "line", F.md5("content").alias("h"), word_count("content").alias("words")).distinct()
    by_line = W.partitionBy(*key).orderBy("line")
    return lines.withColumn("seq", F.row_number().over(by_line)).withColumn("ahead", F.coalesce(F.sum("words").over(by_line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The later repeated runs: doc_id, text_md5, first_line, last_line, n_words, source_doc_id, source_line.

    docs: doc_id, text. Lines count from 0. One row per run and place it repeats: the first place
    in the table of one of its fingerprints, or of a shortest run with lines that those leave out,
    by doc_id (null last), md5 of the text and line.
    Texts without a run of min_words words, null and empty texts have no rows. Two rows of equal
    doc_id and text are one text and not repeats of each other; other copies repeat the first.
    """
    key = ["doc_id", "text_md5"]
    lines = written(_lines(docs), "lines")
    by_words = W.partitionBy(*key).orderBy("ahead").rangeBetween(0, min_words - 1)
    grams = (
        lines.withColumn("gram", F.collect_list("h").over(by_words))
        .withColumn("gram_words", F.sum("words").over(by_words))
        .withColumn("least", F.min(F.struct("h", "seq")).over(by_words))
        .withColumn("gram_md5", F.md5(F.array_join("gram", "")))
    )
    chosen = grams.where(F.col("gram_words") >= min_words).select(*key, F.col("least.seq").alias("seq")).distinct()
    own = grams.where(F.col("gram_words") >= min_words).select(*key, "seq", "gram_md5", F.size("gram").alias("gram_lines"))
    prints = written(_null_safe_semi(own, chosen, [*key, "seq"]), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_md5", "seq")
    firsts = prints.groupBy("gram_md5").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    matches = (
        prints.join(firsts, "gram_md5")
        .where(~place.eqNullSafe(F.col("at")))
        .select(*key, "seq", "gram_lines", F.col("at.doc_id").alias("a_id"), F.col("at.text_md5").alias("a_md5"), F.col("at.seq").alias("a_seq"))
        .withColumn("shift", F.col("seq") - F.col("a_seq"))
    )
    # on one diagonal of two texts each match is extended only as far as its neighbours
    diagonal = W.partitionBy(*key, "a_id", "a_md5", "shift").orderBy("seq")
    matches = matches.withColumn("before", F.lag("seq").over(diagonal)).withColumn("after", F.lead("seq").over(diagonal))
    hashes = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "h", "line", "ahead", "words"))).alias("t"))
    used = written(matches, "matches")
    b_side = hashes.select(F.col("doc_id").alias("b_id"), F.col("text_md5").alias("b_md5"), F.col("t").alias("b"))
    a_side = hashes.select(F.col("doc_id").alias("a2"), F.col("text_md5").alias("m2"), F.col("t.h").alias("a"))
    both = used.join(b_side, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_md5") == F.col("b_md5"))).join(
        a_side, F.col("a_id").eqNullSafe(F.col("a2")) & (F.col("a_md5") == F.col("m2"))
    )
    ahead_most = F.expr("least(size(b) - seq - gram_lines + 1, size(a) - a_seq - gram_lines + 1, coalesce(after - seq - gram_lines, 2147483647))")
    back_most = F.expr("least(seq - 1, a_seq - 1, coalesce(seq - before - 1, 2147483647))")
    grown = both.withColumn("fm", F.greatest(ahead_most, F.lit(0))).withColumn("bm", F.greatest(back_most, F.lit(0)))
    # how many lines agree: the place of the first that differs, less one, or all
    forth = "array_position(zip_with(slice(b.h, seq + gram_lines, fm), slice(a, a_seq + gram_lines, fm), (x, y) -> x = y), false)"
    back = "array_position(zip_with(reverse(slice(b.h, seq - bm, bm)), reverse(slice(a, a_seq - bm, bm)), (x, y) -> x = y), false)"
    grown = grown.withColumn("f", F.expr(f"IF(fm = 0, 0, IF({forth} = 0, fm, {forth} - 1))")).withColumn("k", F.expr(f"IF(bm = 0, 0, IF({back} = 0, bm, {back} - 1))"))
    spans = grown.select(*key, "a_id", "a_md5", "shift", F.expr("seq - k").alias("s"), F.expr("seq + gram_lines - 1 + f").alias("e"), "b")
    # neighbours that met are one run
    by_start = W.partitionBy(*key, "a_id", "a_md5", "shift").orderBy("s", "e")
    spans = spans.withColumn("reach", F.max("e").over(by_start.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.expr("IF(s <= reach + 1, 0, 1)")).over(by_start))
    runs = spans.groupBy(*key, "a_id", "a_md5", "shift", "run").agg(
        F.min("s").alias("s"),
        F.max("e").alias("e"),
        F.min(F.struct("s", F.expr("b[s - 1].line").alias("line"), F.expr("b[s - 1].ahead").alias("ahead"))).alias("at"),
        F.max(F.struct("e", F.expr("b[e - 1].line").alias("line"), F.expr("b[e - 1].ahead + b[e - 1].words").alias("upto"))).alias("to"),
    )
    runs = written(runs.select(*key, "a_id", "shift", "s", "e", "at.line", "at.ahead", F.col("to.line").alias("last_line"), "to.upto"), "runs")
    return runs.unionByName(_left_out(lines, runs, min_words)).select(
        "doc_id",
        "text_md5",
        F.col("line").cast("long").alias("first_line"),
        F.col("last_line").cast("long").alias("last_line"),
        (F.col("upto") - F.col("ahead")).cast("long").alias("n_words"),
        F.col("a_id").alias("source_doc_id"),
        (F.col("s") - F.col("shift")).cast("long").alias("source_line_with_words"),
    )


def _left_out(lines: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """Later runs of several lines that hold a line outside of `runs`, in the columns of `runs`.

    A line of min_words words is its own fingerprint and never left out, so it needs no shortest run.
    """
    key = ["doc_id", "text_md5"]
    upto = F.col("ahead") + F.col("words")
    from_line = W.partitionBy(*key).orderBy("ahead").rangeBetween(0, min_words - 1)
    up_to_line = W.partitionBy(*key).orderBy("upto").rangeBetween(1 - min_words, 0)
    part = F.struct("seq", "h", "line", "ahead", "words")
    both = lines.withColumn("upto", upto).withColumn("x", F.collect_list(part).over(from_line)).withColumn("y", F.collect_list(part).over(up_to_line))
    both = both.select(*key, F.explode(F.array_distinct(F.array("x", "y"))).alias("g")).where("size(g) > 1 AND aggregate(g, 0L, (n, l) -> n + l.words) >= " + str(min_words))
    grams = both.select(
        *key, F.expr("unhex(md5(array_join(g.h, '')))").alias("gram"), F.expr("g[0].seq").alias("s"), F.expr("element_at(g, -1).seq").alias("e"),
        F.expr("g[0].line").alias("line"), F.expr("g[0].ahead").alias("ahead"), F.expr("element_at(g, -1).line").alias("last_line"), F.expr("element_at(g, -1).ahead + element_at(g, -1).words").alias("upto"),
    ).distinct()
    grams = written(grams, "grams")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_md5", F.col("s").alias("seq"))
    firsts = grams.groupBy("gram").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = grams.join(firsts, "gram").where(~place.eqNullSafe(F.col("at")))
    covered = runs.groupBy(*key).agg(F.collect_set(F.struct("s", "e")).alias("covered")).select(F.col("doc_id").alias("c_id"), F.col("text_md5").alias("c_md5"), "covered")
    later = later.join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_md5") == F.col("c_md5")), "left")
    later = later.where("covered IS NULL OR NOT forall(sequence(s, e), i -> exists(covered, r -> i BETWEEN r.s AND r.e))")
    later = later.select(*key, F.col("at.doc_id").alias("a_id"), F.col("at.text_md5").alias("a_md5"), (F.col("s") - F.col("at.seq")).alias("shift"), "s", "e", "line", "ahead", "last_line", "upto")
    # neighbours on one diagonal of two texts are one run
    by_start = W.partitionBy(*key, "a_id", "a_md5", "shift").orderBy("s", "e")
    later = later.withColumn("reach", F.max("e").over(by_start.rowsBetween(W.unboundedPreceding, -1)))
    later = later.withColumn("run", F.sum(F.expr("IF(s <= reach + 1, 0, 1)")).over(by_start))
    return later.groupBy(*key, "a_id", "a_md5", "shift", "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min("line").alias("line"), F.min("ahead").alias("ahead"), F.max("last_line").alias("last_line"), F.max("upto").alias("upto")
    ).drop("a_md5", "run")


def _null_safe_semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_{c}") for c in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[f"_{c}"])
    return left.join(right, cond, "left_semi")


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without its later repeated runs of lines; all other columns as they are.

    A text of which only lines without words are left is dropped with its row; a row whose text
    was null, empty or without words to begin with stays.
    """
    found = repeated_runs(docs, min_words).groupBy("doc_id", "text_md5").agg(F.collect_set(F.struct("first_line", "last_line")).alias("runs"))
    runs, own_id, digest, left = free(docs, "line_runs", "run_doc_id", "run_text_md5", "text_left")
    found = found.select(F.col("doc_id").alias(own_id), F.col("text_md5").alias(digest), F.col("runs").alias(runs))
    hit = docs.join(found, docs.doc_id.eqNullSafe(F.col(own_id)) & (F.md5(docs.text.cast("string")) == F.col(digest)), "left")
    rest = F.expr(f"array_join(filter(split(text, '\\n'), (l, i) -> NOT exists({runs}, r -> i BETWEEN r.first_line AND r.last_line)), '\\n')")
    whole = F.col(runs).isNull()
    out = hit.withColumn(left, F.when(whole, F.col("text")).otherwise(rest)).where(whole | (word_count(left) > 0))
    n_chars = lambda: F.when(whole, F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[F.col(left).alias("text") if c == "text" else n_chars() if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
