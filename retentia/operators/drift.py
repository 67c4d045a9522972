"""Drift between a reference table (training data) and a current table.

* ``mean_delta``: the original's summary (mean per column on each side and
  the difference), from one aggregation pass over the tagged union.
* ``distribution_drift``: per column PSI over reference deciles, the
  two-sample Kolmogorov-Smirnov statistic and the 1-D Wasserstein distance,
  all from ONE prefix scan: both sides are reduced to distinct (column,
  value) counts, ranked per column with the bucketed prefix scan, and
  the empirical CDFs are read off the running counts. Decile buckets need no
  collected cut points: a value's reference-decile bucket is
  ``floor(10 * #reference values below it / n_reference)``.
* ``drift_summary``: share of drifted columns + row counts.
* ``quality_by_side``: classification quality of each side.

The original delegates the distribution part to a third-party preset whose
thresholds it does not state; ours are PSI > 0.2 or KS > 0.1 (config).
NaN counts as missing (skipped), as in pandas.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DATASET_DRIFT_SHARE, DEFAULT_CONFIG, PSI_FLOOR, RenewalConfig
from .metrics import binary_metrics, ranking_metrics
from .prefix import value_scan
from .quantiles import long_form
from ..session import stored

SIDE = "side"
REFERENCE = "reference"
CURRENT = "current"


def tag_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    cols = [F.col(c).cast(T.DoubleType()).alias(c) for c in columns]
    return reference.select(F.lit(REFERENCE).alias(SIDE), *cols).unionByName(
        current.select(F.lit(CURRENT).alias(SIDE), *cols)
    )


def drift_columns(reference: DataFrame, current: DataFrame, features: Sequence[str], target: str, probability: str | None) -> list[str]:
    """Features, then the probability, then the target only when both sides
    carry it."""
    cols = list(features)
    if probability:
        cols.append(probability)
    if target in reference.columns and target in current.columns:
        cols.append(target)
    return cols


def mean_delta(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, reference_mean, current_mean, mean_delta)``."""
    tagged = tag_sides(reference, current, columns)
    aggs = []
    for c in columns:
        v = F.nanvl(F.col(c), F.lit(None).cast(T.DoubleType()))
        aggs.append(F.avg(F.when(F.col(SIDE) == REFERENCE, v)).alias(f"r_{c}"))
        aggs.append(F.avg(F.when(F.col(SIDE) == CURRENT, v)).alias(f"c_{c}"))
    wide = tagged.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"r_{c}").alias("reference_mean"),
                F.col(f"c_{c}").alias("current_mean"),
                (F.col(f"c_{c}") - F.col(f"r_{c}")).alias("mean_delta"),
            )
            for c in columns
        ]
    )
    return wide.select(F.inline(rows))


def _value_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    tagged = tag_sides(reference, current, columns)
    values = long_form(tagged, columns, keep=[SIDE]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return values.groupBy("column", "value").agg(
        F.count(F.when(F.col(SIDE) == REFERENCE, 1)).alias("ref_cnt"),
        F.count(F.when(F.col(SIDE) == CURRENT, 1)).alias("cur_cnt"),
    )


def distribution_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    config: RenewalConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """``(column, psi, ks_statistic, wasserstein, drifted)``; all null where a
    side has no value of the column. A column without any value has no row."""
    counts = stored(_value_counts(reference, current, columns), "drift_counts")
    sizes = counts.groupBy("column").agg(F.sum("ref_cnt").alias("n_ref"), F.sum("cur_cnt").alias("n_cur"))
    scanned = value_scan(counts, "value", ["column"], sums=["ref_cnt", "cur_cnt"], lead=True, input_stored=True)
    # one row per column: a broadcast with a proven bound
    rows = scanned.join(F.broadcast(sizes), "column")
    # a side without values has no distribution: all statistics are null
    f_ref = F.try_divide(F.col("cum_ref_cnt").cast(T.DoubleType()), F.col("n_ref").cast(T.DoubleType()))
    f_cur = F.try_divide(F.col("cum_cur_cnt").cast(T.DoubleType()), F.col("n_cur").cast(T.DoubleType()))
    gap = F.abs(f_ref - f_cur)
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))

    b = int(config.psi_buckets)
    below = F.col("cum_ref_cnt") - F.col("ref_cnt")
    bucket = F.least(F.lit(b - 1).cast(T.LongType()), F.floor(F.try_divide(F.lit(b) * below, F.col("n_ref"))).cast(T.LongType()))
    # one pass: per (column, decile bucket) the shares and the partial KS /
    # Wasserstein terms, then per column (at most b rows per column)
    per_bucket = rows.groupBy("column", bucket.alias("bucket")).agg(
        F.try_divide(F.sum("ref_cnt"), F.first("n_ref")).alias("p_ref"),
        F.try_divide(F.sum("cur_cnt"), F.first("n_cur")).alias("p_cur"),
        F.max(gap).alias("_ks"),
        F.sum(gap * step).alias("_w"),
    )
    floor = F.lit(PSI_FLOOR)
    pr, pc = (F.when(F.col(p).isNotNull(), F.greatest(F.col(p), floor)) for p in ("p_ref", "p_cur"))
    out = per_bucket.groupBy("column").agg(
        F.sum((pc - pr) * F.log(pc / pr)).alias("psi"),
        F.max("_ks").alias("ks_statistic"),
        F.sum("_w").alias("wasserstein"),
    )
    return out.select(
        "column",
        "psi",
        "ks_statistic",
        "wasserstein",
        ((F.col("psi") > F.lit(config.psi_threshold)) | (F.col("ks_statistic") > F.lit(config.ks_threshold))).alias("drifted"),
    )


def drift_summary(drift: DataFrame, reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row: column count, drifted count and share, dataset-drift flag,
    row counts of both sides (one aggregation over a union, no join)."""
    zero, one = F.lit(0).cast(T.LongType()), F.lit(1).cast(T.LongType())

    def part(c: F.Column, d: F.Column, r: F.Column, k: F.Column) -> list[F.Column]:
        return [c.alias("c"), d.alias("d"), r.alias("r"), k.alias("k")]

    parts = (
        drift.select(*part(one, F.col("drifted").cast(T.LongType()), zero, zero))
        .unionByName(reference.select(*part(zero, zero, one, zero)))
        .unionByName(current.select(*part(zero, zero, zero, one)))
    )
    totals = parts.agg(
        F.sum("c").alias("n_columns"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_drifted"), F.sum("r").alias("reference_rows"), F.sum("k").alias("current_rows")
    )
    share = F.try_divide(F.col("n_drifted"), F.col("n_columns"))
    return totals.select(
        "n_columns",
        "n_drifted",
        share.alias("share_drifted"),
        (share >= F.lit(DATASET_DRIFT_SHARE)).alias("dataset_drift"),
        "reference_rows",
        "current_rows",
    )


def quality_by_side(
    reference: DataFrame, current: DataFrame, label: str, probability: str, prediction: str, positive: int = 1
) -> DataFrame:
    """``(side, accuracy, precision, recall, f1, roc_auc, average_precision)``."""
    # predictions are 1 for the positive class, whatever its value is in the label
    cols = [(F.col(label) == positive).cast(T.IntegerType()).alias(label), F.col(probability), F.col(prediction)]
    tagged = reference.select(F.lit(REFERENCE).alias(SIDE), *cols).unionByName(current.select(F.lit(CURRENT).alias(SIDE), *cols))
    # one prefix scan for both ranking metrics; the join is on the side
    # (two rows on each side of it)
    return binary_metrics(tagged, label, prediction, [SIDE]).join(ranking_metrics(tagged, label, probability, [SIDE]), SIDE)
