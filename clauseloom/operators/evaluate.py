"""Evaluation tables: threshold sweep, class report, derived metrics, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the sweep and the one in use.
THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6]
DEFAULT_THRESHOLD = 0.3


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def threshold_sweep(scores: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """``scores``: truth 0/1, score.  Accuracy, P, R, F1 and the confusion counts per threshold.

    One pass: conditional sums for every threshold, then the sums are unfolded.
    """
    pos = F.col("truth") == 1
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") > t
        aggs += [F.count_if(hit & pos).alias(f"tp{i}"), F.count_if(hit & ~pos).alias(f"fp{i}"),
                 F.count_if(~hit & pos).alias(f"fn{i}"), F.count_if(~hit & ~pos).alias(f"tn{i}")]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn", "tn")])
                     for i, t in enumerate(thresholds)])
    m = scores.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return m.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn(
        "accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, f1 and rank by f1 from both ends."""
    c = confusion(predictions)
    hits = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    truth = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hits.alias("tp"))
    found = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    both = truth.join(found, "label", "full").na.fill(0, ["support", "tp", "n_predicted"])
    p, r = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("support"))
    return both.select("label", "support", p.alias("precision"), r.alias("recall"),
                       ratio(2 * p * r, p + r).alias("f1"))


def best_and_worst(report: DataFrame, n: int = 5) -> DataFrame:
    # One row per class, so the global windows stay as small as the label set.
    best = report.orderBy(F.desc("f1"), "label").limit(n).withColumn("side", F.lit("best"))
    worst = report.orderBy("f1", "label").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def weighted_summary(predictions: DataFrame) -> DataFrame:
    report = class_report(predictions)
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    hits = F.sum(F.col("recall") * F.col("support"))
    return report.agg(F.sum("support").alias("n"), (hits / F.sum("support")).alias("accuracy"),
                      w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"),
                      w("f1").alias("weighted_f1"), F.count_if(F.col("support") > 0).alias("n_classes"))


def derived_metrics(sweep: DataFrame, stage2_accuracy: float, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Specificity, FPR, FNR, PPV, NPV and the two-stage accuracy at one threshold."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    specificity, recall = ratio(tn, tn + fp), ratio(tp, tp + fn)
    positive = ratio(tp + fn, n)
    return sweep.where(F.col("threshold") == threshold).select(
        "threshold", specificity.alias("specificity"), recall.alias("sensitivity"),
        ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fn, fn + tp).alias("false_negative_rate"),
        ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"), positive.alias("positive_ratio"),
        (positive * recall * stage2_accuracy + ratio(tn + fp, n) * specificity).alias("pipeline_accuracy"),
        (ratio(tp, tp + fp) * stage2_accuracy).alias("pipeline_precision"), (1 - positive).alias("work_avoided"))


def threshold_improvement(sweep: DataFrame, threshold: float = DEFAULT_THRESHOLD, base: float = 0.5) -> DataFrame:
    """Change in recall, precision, f1 and accuracy against the default threshold."""
    def diff(c):
        at = lambda t: F.max(F.when(F.col("threshold") == t, F.col(c)))
        return at(threshold) - at(base)

    return sweep.agg(diff("recall").alias("recall_improvement"), diff("precision").alias("precision_change"),
                     diff("f1").alias("f1_improvement"), diff("accuracy").alias("accuracy_change"))


def agreement(predictions: DataFrame) -> DataFrame:
    """Prediction/truth agreement per type; rows with ``unknown`` on either side drop out."""
    known = predictions.where("truth <> 'unknown' AND predicted <> 'unknown'")
    return known.groupBy("truth").agg(F.count("*").alias("total"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct"),
                                      F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("accuracy"))


def agreement_summary(predictions: DataFrame) -> DataFrame:
    per_type = agreement(predictions)
    return per_type.agg(F.sum("total").alias("total_classified"), F.sum("correct").alias("correct_predictions"),
                        ratio(F.sum("correct"), F.sum("total")).alias("overall_accuracy"),
                        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("average_type_accuracy"))


def concentration(labels: DataFrame, n: int = 5) -> DataFrame:
    """Share of the top labels, ratio of the first to the n-th, share of the first."""
    counts = labels.groupBy("label").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    top = counts.orderBy(F.desc("c"), "label").limit(n).agg(
        F.sum("c").alias("top"), F.max("c").alias("first"), F.min("c").alias("last"),
        F.max_by("label", F.struct("c")).alias("dominant_label"))
    return top.crossJoin(total).select(
        "total", (F.col("top") / F.col("total")).alias("top_share"), (F.col("first") / F.col("last")).alias("first_to_last"),
        "dominant_label", (F.col("first") / F.col("total")).alias("dominant_share"))


def top_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    order = Window.orderBy(F.desc("n_rows"), column)
    top = rows.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), column).limit(n)
    return top.withColumn("rank", F.row_number().over(order))
