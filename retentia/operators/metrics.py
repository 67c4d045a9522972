"""Binary classification metrics as distributed aggregations.

* Threshold metrics (confusion matrix, accuracy, precision, recall, F1 and the
  per-class report) come from four conditional counts: one aggregation pass
  with partial aggregation, whatever the row count.
* ROC-AUC is the exact Mann-Whitney statistic with ties at half weight:
  rows are first reduced to distinct scores with positive / negative counts,
  then running counts from high to low scores come from the bucketed
  prefix scan (``operators.prefix``). The numerator is an exact integer
  (decimal) sum.
* Average precision is ``sum((R_i - R_{i-1}) * P_i)`` over distinct scores in
  descending order (not the trapezoid area), from the same scan: both
  metrics of a population cost one scan.

All functions take optional ``group_by`` columns so that the same plan
scores several populations (e.g. the two drift sides) at once.
Zero denominators give 0.0, as in the original's ``zero_division=0``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import value_scan


def _div0(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast(T.DoubleType()) / den.cast(T.DoubleType()))


def confusion_counts(df: DataFrame, label: str, prediction: str, group_by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """``(group..., tn, fp, fn, tp)`` from one aggregation pass."""
    y = F.col(label) == positive
    p = F.col(prediction) == positive

    def cnt(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return df.groupBy(*group_by).agg(
        cnt(~y & ~p).alias("tn"), cnt(~y & p).alias("fp"), cnt(y & ~p).alias("fn"), cnt(y & p).alias("tp")
    )


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, group_by: Sequence[str] = (), positive: int = 1
) -> DataFrame:
    """Long form ``(group..., actual, predicted, count)``: all four cells,
    zeros included (``[[tn, fp], [fn, tp]]``); 1 stands for the positive class."""
    return matrix_from_counts(confusion_counts(df, label, prediction, group_by, positive), group_by)


def matrix_from_counts(counts: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("count")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("count")),
    )
    return counts.select(*group_by, F.inline(cells))


def metrics_from_counts(counts: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    return counts.select(
        *group_by,
        _div0(tp + tn, total).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def binary_metrics(
    df: DataFrame, label: str, prediction: str, group_by: Sequence[str] = (), positive: int = 1
) -> DataFrame:
    """``(group..., accuracy, precision, recall, f1)`` of the positive class."""
    return metrics_from_counts(confusion_counts(df, label, prediction, group_by, positive), group_by)


def classification_report(
    df: DataFrame, label: str, prediction: str, group_by: Sequence[str] = (), positive: int = 1
) -> DataFrame:
    """``report_from_counts`` of a scored table."""
    return report_from_counts(confusion_counts(df, label, prediction, group_by, positive), group_by)


def report_from_counts(c: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro and
    support-weighted averages: ``(group..., label, precision, recall,
    f1_score, support)``. The accuracy row repeats accuracy in the three
    score columns and carries the total as support."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    s0, s1 = (tn + fp).cast(T.DoubleType()), (tp + fn).cast(T.DoubleType())
    total = s0 + s1
    p0, r0, f0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    acc = _div0(tp + tn, tn + fp + fn + tp)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1_score"),
            s.alias("support"),
        )

    def wavg(a: Column, b: Column) -> Column:
        return F.when(total == 0, F.lit(0.0)).otherwise((a * s0 + b * s1) / total)

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", acc, acc, acc, total),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), total),
    )
    return c.select(*group_by, F.inline(rows))


def score_counts(df: DataFrame, label: str, score: str, group_by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """Distinct scores with positive / negative counts (partial aggregation)."""
    y = F.col(label) == positive
    return (
        df.where(F.col(score).isNotNull() & ~F.isnan(score))
        .groupBy(*group_by, score)
        .agg(F.count(F.when(y, 1)).alias("pos"), F.count(F.when(~y, 1)).alias("neg"))
    )


def ranking_metrics(
    df: DataFrame, label: str, score: str, group_by: Sequence[str] = (), positive: int = 1
) -> DataFrame:
    """``(group..., roc_auc, average_precision)`` from ONE prefix scan of
    the distinct scores, high to low.

    With ``cum_pos`` / ``cum_neg`` = positives / negatives scoring at least
    the current score, and P, N the class totals:

    * ROC-AUC = (2PN - sum(pos * (2 * cum_neg - neg))) / 2PN: the subtracted
      sum counts each (positive, negative) pair whose negative scores higher
      twice and each tie once; numerator and denominator are exact integers
      (decimal sums). Null when a group has only one class.
    * average precision = sum(pos * cum_pos / (cum_pos + cum_neg)) / P.
    """
    counts = score_counts(df, label, score, group_by, positive).withColumn("_desc", -F.col(score))
    scanned = value_scan(counts, "_desc", group_by, sums=["pos", "neg"])
    above = F.col("pos").cast(T.DecimalType(18, 0)) * (2 * F.col("cum_neg") - F.col("neg")).cast(T.DecimalType(19, 0))
    precision = F.col("cum_pos").cast(T.DoubleType()) / (F.col("cum_pos") + F.col("cum_neg")).cast(T.DoubleType())
    agg = scanned.groupBy(*group_by).agg(
        F.sum(above).alias("_above"),
        F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    pairs2 = F.lit(2).cast(T.DecimalType(1, 0)) * F.col("_p").cast(T.DecimalType(18, 0)) * F.col("_n").cast(T.DecimalType(18, 0))
    auc = (pairs2 - F.col("_above")).cast(T.DoubleType()) / pairs2.cast(T.DoubleType())
    return agg.select(
        *group_by,
        F.when(pairs2 == 0, F.lit(None)).otherwise(auc).alias("roc_auc"),
        F.when(F.col("_p") == 0, F.lit(None)).otherwise(F.col("_ap") / F.col("_p")).alias("average_precision"),
    )


def roc_auc(
    df: DataFrame, label: str, score: str, group_by: Sequence[str] = (), positive: int = 1
) -> DataFrame:
    """``(group..., roc_auc)``: exact, ties count one half."""
    return ranking_metrics(df, label, score, group_by, positive).select(*group_by, "roc_auc")


def average_precision(
    df: DataFrame, label: str, score: str, group_by: Sequence[str] = (), positive: int = 1
) -> DataFrame:
    """``(group..., average_precision)``: precision at each distinct score
    weighted by the recall gained there, scores taken from high to low."""
    return ranking_metrics(df, label, score, group_by, positive).select(*group_by, "average_precision")
