"""Queries of the evaluation operators. Scores are made from labels and a hash of the doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.labels import hash_share
from tessera.plans.catalogue import query
from tessera.sources import table

_SHARE = "('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0"
_S = f"""s AS (SELECT doc_id, toxic AS y, round(0.6 * {_SHARE} + 0.35 * toxic, 2) AS p, quality FROM labels),
  d AS (SELECT *, (p > 0.5)::INT AS yhat FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    p = F.round(0.6 * hash_share(F.col("doc_id"), 7) + 0.35 * F.col("toxic"), 2)
    return labels.select("doc_id", F.col("toxic").alias("y"), p.alias("p"), "quality").withColumn("yhat", (F.col("p") > 0.5).cast("int"))


_RATES = """coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def _round_sql(inner: str, keep: str, *columns: str) -> str:
    return f"SELECT {keep}, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM ({inner})"


@query(f"WITH {_S}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM d) "
       + _round_sql(f"SELECT *, {_RATES} FROM c", "tp, fp, fn, tn", "accuracy", "precision", "recall", "f1"))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.confusion(_scored(spark, sf_dir), F.col("y"), F.col("yhat")), "accuracy", "precision", "recall", "f1")


_REPORT = """r AS (SELECT class, count(*) FILTER (WHERE t) AS support, count(*) FILTER (WHERE NOT t) AS np, sum(hit)::BIGINT AS tp FROM (
  SELECT y AS class, true AS t, (y = yhat)::INT AS hit FROM d UNION ALL SELECT yhat, false, 0 FROM d) GROUP BY class),
  report AS (SELECT class, coalesce(tp / nullif(np, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(support + np, 0)::DOUBLE, 0) AS f1, support FROM r)"""


@query(f"WITH {_S}, {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.class_report(_scored(spark, sf_dir), "y", "yhat"), "precision", "recall", "f1")


@query(f"WITH {_S}, {_REPORT} SELECT round(avg(f1), 6) AS macro_f1 FROM report")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.macro_f1(M.class_report(_scored(spark, sf_dir), "y", "yhat")), "macro_f1")


@query(f"WITH {_S} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM s a JOIN s b ON a.y = 1 AND b.y = 0")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.roc_auc(_scored(spark, sf_dir), F.col("y"), "p"), "auc")


@query(f"""WITH {_S}, c AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p)
  SELECT score, round(sum(pos) OVER w / (SELECT sum(pos) FROM c), 6) AS tpr, round(sum(neg) OVER w / (SELECT sum(neg) FROM c), 6) AS fpr FROM c WINDOW w AS (ORDER BY score DESC)""")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.roc_curve(_scored(spark, sf_dir), F.col("y"), "p"), "tpr", "fpr")


_BINARY = [round(0.05 + 0.01 * i, 2) for i in range(91)]
_CLASS = [round(0.1 + 0.05 * i, 2) for i in range(17)]


@query(f"""WITH {_S}, t AS (SELECT unnest({_BINARY}::DOUBLE[]) AS threshold),
  c AS (SELECT threshold, count(*) FILTER (WHERE y = 1 AND p > threshold) AS tp, count(*) FILTER (WHERE y = 0 AND p > threshold) AS fp, count(*) FILTER (WHERE y = 1 AND p <= threshold) AS fn, count(*) FILTER (WHERE y = 0 AND p <= threshold) AS tn FROM s, t GROUP BY 1),
  f AS (SELECT threshold, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2 AS f FROM c)
  SELECT threshold, round(f, 6) AS macro_f1 FROM f ORDER BY round(f, 12) DESC, threshold LIMIT 1""")
def threshold_sweep_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.best_binary_threshold(_scored(spark, sf_dir), "y", "p", _BINARY), "macro_f1")


@query(f"""WITH {_S}, k AS (SELECT doc_id % 5 AS class, p, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE y END AS y FROM s), t AS (SELECT unnest({_CLASS}::DOUBLE[]) AS threshold),
  c AS (SELECT class, threshold, count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE y = 0 AND p >= threshold) AS fp, count(*) FILTER (WHERE y = 1 AND p < threshold) AS fn FROM k, t GROUP BY 1, 2),
  v AS (SELECT *, 0.6 * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + 0.4 * coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS v FROM c),
  b AS (SELECT class, threshold FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(v, 12) DESC, threshold) AS n FROM v WHERE tp + fp > 0) WHERE n = 1)
  SELECT a.class, greatest(CASE WHEN a.pos = 0 THEN 0.9 ELSE coalesce(b.threshold, 0.5) END, 0.2) AS threshold FROM (SELECT class, sum(y) AS pos FROM k GROUP BY 1) a LEFT JOIN b ON b.class = a.class""")
def threshold_sweep_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _scored(spark, sf_dir).select((F.col("doc_id") % 5).alias("class"), "p", F.when(F.col("doc_id") % 5 == 4, 0).otherwise(F.col("y")).alias("y"))
    return M.best_class_thresholds(k, "class", "y", "p", _CLASS)


_SETS = """m AS (SELECT doc_id, list_filter([CASE WHEN toxic = 1 THEN 'a' END, CASE WHEN quality = 1 THEN 'b' END, CASE WHEN doc_id % 7 = 0 THEN 'c' END], lambda x: x IS NOT NULL) AS t,
  list_filter([CASE WHEN doc_id % 2 = 0 THEN 'a' END, CASE WHEN doc_id % 3 > 0 THEN 'b' END, CASE WHEN doc_id % 14 = 0 THEN 'c' END], lambda x: x IS NOT NULL) AS p FROM labels)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    some = lambda *conds: F.array_compact(F.array(*[F.when(c, n) for c, n in zip(conds, "abc", strict=True)]))
    return table(spark, sf_dir, "labels").select("doc_id", some(F.col("toxic") == 1, F.col("quality") == 1, i % 7 == 0).alias("t"), some(i % 2 == 0, i % 3 > 0, i % 14 == 0).alias("p"))


@query(f"""WITH {_SETS}, k AS (SELECT len(list_intersect(t, p)) AS i, len(list_distinct(list_concat(t, p))) AS u FROM m)
  SELECT round(avg(1 - (u - i) / 3.0), 6) AS hamming, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u::DOUBLE END), 6) AS jaccard FROM k""")
def hamming_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.hamming_jaccard(_sets(spark, sf_dir), "t", "p", 3), "hamming", "jaccard")


@query(f"""WITH {_SETS}, a AS (SELECT unnest(CASE WHEN len(t) = 0 THEN ['Safe'] ELSE t END) AS "true", CASE WHEN len(p) = 0 THEN ['Safe'] ELSE p END AS p FROM m)
  SELECT "true", predicted, count(*) AS n FROM (SELECT "true", unnest(p) AS predicted FROM a) GROUP BY 1, 2""")
def pair_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pair_confusion(_sets(spark, sf_dir), "t", "p", "Safe")


@query(f"""WITH {_S}, c AS (SELECT y * 0.9 + 0.05 AS y, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM s)
  SELECT round(avg(-0.75 * 2.0 * y * pow(1 - p, 2.0) * ln(p) - 0.25 * (1 - y) * pow(p, 2.0) * ln(1 - p)), 6) AS loss FROM c""")
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.round(F.avg(M.focal_loss(F.col("p"), F.col("y"), 0.75, 2.0, 2.0, 0.1)), 6).alias("loss"))


_DIMS = [f"d{i}" for i in range(64)]


@query("WITH v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(64)) + " FROM embeddings) SELECT vec_id, label, "
       + ", ".join(f"round(CASE WHEN count(*) OVER w > 1 THEN ({d} - avg({d}) OVER w) / (stddev_samp({d}) OVER w + 1e-6) ELSE {d} END, 6) AS {d}" for d in _DIMS) + " FROM v WINDOW w AS (PARTITION BY label)")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(_DIMS)])
    return _rounded(M.zscore(v, ["label"], _DIMS), *_DIMS)


@query("""SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS class, round(1 / (1 + exp(-list_max(embedding)::DOUBLE)), 6) AS confidence FROM embeddings WHERE 1 / (1 + exp(-list_max(embedding)::DOUBLE)) > 0.56""")
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected, kind, confidence = M.detections(F.col("embedding").cast("array<double>"), 0.56)
    return table(spark, sf_dir, "embeddings").where(detected).select("vec_id", kind.alias("class"), F.round(confidence, 6).alias("confidence"))
