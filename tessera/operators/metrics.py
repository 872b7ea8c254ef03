"""Evaluation: confusion, F1, AUC with ties, threshold sweeps, multi-label scores, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def to_binary(x: Column) -> Column:
    """1 above one half, 0 for everything else, whatever can't be read as a number included."""
    return F.when(x.try_cast("double") > 0.5, 1).otherwise(0)


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, truth: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 (0 where undefined), per key."""
    t, p = truth == 1, predicted == 1
    counts = [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]
    c = df.groupBy(*(keys or [])).agg(*counts)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", _div(tp + tn, tp + tn + fp + fn).alias("accuracy"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support of every class that occurs; one pass over exploded outcomes."""
    o = df.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    s = o.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("n_predicted"), F.sum("hit").alias("tp"))
    return s.select("class", _div(F.col("tp"), F.col("n_predicted")).alias("precision"), _div(F.col("tp"), F.col("support")).alias("recall"), _div(2 * F.col("tp"), F.col("support") + F.col("n_predicted")).alias("f1"), "support")


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("macro_f1"))


def score_counts(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """score, pos, neg per distinct score: what ranking metrics need, however many rows there are."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(truth == 1).alias("pos"), F.count_if(truth != 1).alias("neg"))


def _below(counts: DataFrame, ranges: int = 64) -> DataFrame:
    """score_counts with pos_below and neg_below, the sums over smaller scores, without one sorted task.

    Scores are dealt into ranges by sampled quantiles; sums of whole ranges come first, then sums inside.
    """
    cuts = counts.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    placed = counts.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    parts = placed.groupBy("_part").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")).select("_part", before("_pos", earlier).alias("_p"), before("_neg", earlier).alias("_n"))
    out = placed.withColumn("pos_below", before("pos", inside)).withColumn("neg_below", before("neg", inside)).join(F.broadcast(parts), "_part")  # a row a range
    return out.select("score", "pos", "neg", (F.col("pos_below") + F.col("_p")).alias("pos_below"), (F.col("neg_below") + F.col("_n")).alias("neg_below"))


def roc_curve(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """score, tpr, fpr at every distinct score taken as the threshold (score >= threshold is positive)."""
    c = score_counts(df, truth, score)
    total = c.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    rate = lambda below, all_: _div(F.col(all_) - F.col(below), F.col(all_))
    return _below(c).crossJoin(F.broadcast(total)).select("score", rate("pos_below", "_p").alias("tpr"), rate("neg_below", "_n").alias("fpr"))


def roc_auc(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """Area under the curve by rank sums, ties count half; 0.5 if a class is missing."""
    c = score_counts(df, truth, score)
    return _below(c).withColumn("_u", F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).agg(F.coalesce(F.sum("_u") / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0)), F.lit(0.5)).alias("auc"))


def sweep(df: DataFrame, truth: str, score: str, thresholds: list[float], keys: list[str], strict: bool) -> DataFrame:
    """Confusion at every threshold and key.

    Rows are counted by the number of thresholds they pass, then summed from above, so the table is
    read once and never multiplied by the thresholds.
    """
    passed = sum((F.when(F.col(score) > t if strict else F.col(score) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    binned = df.select(*keys, F.col(truth).alias("_y"), passed.alias("_k")).groupBy(*keys, "_k").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    bins = binned.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])))
    hit = F.col("_k") > F.col("_t.i")
    c = bins.groupBy(*keys, F.col("_t.threshold").alias("threshold")).agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    return c.select("*", f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"), _div(tp, tp + fp).alias("precision"))


def best_binary_threshold(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """The threshold of the best macro F1 under a strict `>`; the smallest of equals."""
    s = sweep(df, truth, score, thresholds, [], strict=True)
    return s.agg(F.max_by("threshold", F.struct(F.round("macro_f1", 12), -F.col("threshold"))).alias("threshold"), F.max("macro_f1").alias("macro_f1"))


def best_class_thresholds(df: DataFrame, key: str, truth: str, score: str, thresholds: list[float], floor: float = 0.2, none: float = 0.9) -> DataFrame:
    """Per class the threshold of the best 0.6 F1 + 0.4 precision under `>=`; 0.9 without positives, 0.2 at least."""
    s = sweep(df, truth, score, thresholds, [key], strict=False)
    value = 0.6 * F.col("f1") + 0.4 * F.col("precision")
    some = F.when(F.col("tp") + F.col("fp") > 0, F.struct(F.round(value, 12), -F.col("threshold")))
    best = s.groupBy(key).agg(F.max(F.col("tp") + F.col("fn")).alias("_pos"), F.max_by("threshold", some).alias("_t"))
    return best.select(key, F.greatest(F.when(F.col("_pos") == 0, none).otherwise(F.coalesce("_t", F.lit(0.5))), F.lit(floor)).alias("threshold"))


def hamming_jaccard(df: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """Share of equal cells, and mean overlap of the label sets (1 if both are empty), of array columns of class numbers."""
    inter, union = F.size(F.array_intersect(truth, predicted)), F.size(F.array_union(truth, predicted))
    return df.agg(F.avg(1 - (union - inter) / classes).alias("hamming"), F.avg(F.when(union == 0, 1.0).otherwise(inter / union)).alias("jaccard"))


def pair_confusion(df: DataFrame, truth: str, predicted: str, empty: str) -> DataFrame:
    """true, predicted, n over all pairs of a row's true and predicted classes; an empty set is `empty`."""
    full = lambda c: F.when(F.size(c) == 0, F.array(F.lit(empty))).otherwise(F.col(c))
    pairs = df.select(F.explode(full(truth)).alias("true"), full(predicted).alias("_p")).select("true", F.explode("_p").alias("predicted"))
    return pairs.groupBy("true", "predicted").agg(F.count("*").alias("n"))


def focal_loss(p: Column, y: Column, alpha: float, gamma: float, positive_weight: float = 1.0, smoothing: float = 0.0, eps: float = 1e-7) -> Column:
    """Focal loss of a probability, kept eps away from 0 and 1; labels may be smoothed towards a half."""
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    y = y * (1 - smoothing) + 0.5 * smoothing
    pos = -alpha * positive_weight * y * F.pow(1 - p, F.lit(gamma)) * F.ln(p)
    return pos - (1 - alpha) * (1 - y) * F.pow(p, F.lit(gamma)) * F.ln(1 - p)


def zscore(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns less their mean over their sample deviation + 1e-6, per key; keys of one row stay as they are."""
    stats = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = df.join(stats, keys)
    return joined.select(*[c for c in df.columns if c not in columns], *[F.when(F.col("_n") > 1, (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6)).otherwise(F.col(c)).alias(c) for c in columns])


def detections(logits: Column, threshold: float) -> tuple[Column, Column, Column]:
    """(detected, class, confidence) of a node: its most probable class (the first of equals), if above the threshold."""
    top = F.array_max(logits)
    confidence = 1 / (1 + F.exp(-top))
    return confidence > threshold, F.array_position(logits, top) - 1, confidence
