"""Exact quantiles (medians) of many columns at once.

``percentile``/``median`` hold a group's values in one task. Here the columns
are turned into long form and the exact quantile is found inside the JVM:

1. a mergeable percentile sketch per column (``percentile_approx``, partial
   aggregation, bounded memory) brackets every target position: its rank
   error is at most n / ``SKETCH_ACCURACY``, so the values at p -/+
   ``BRACKET_MARGIN`` errors enclose the target;
2. one aggregation counts the rows below the bracket and each distinct value
   inside it (a value held by a third of the rows costs one row per map
   task); the result, about 0.06 % of the rows, is stored;
3. the bucketed prefix scan over the in-bracket values gives their positions,
   and the rows at the two positions around the target give the value, with
   linear interpolation as in NumPy / pandas.

The bracket table has one row per (column, probability) and is broadcast. A
bracket that the exact counts do not confirm is an error, never a null (the
sketch's guarantee rules it out).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .prefix import value_scan

# Fixed parameters of the bracket: sketch accuracy (rank error <= n / 10,000)
# and the bracket half-width in sketch errors.
SKETCH_ACCURACY = 10_000
BRACKET_MARGIN = 3


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., column, value)``: one row per (input row, column)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(T.DoubleType()).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))


def _positions(sized: DataFrame) -> DataFrame:
    """Adds the 1-based positions around ``(n - 1) * probability``."""
    h = (F.col("n") - 1) * F.col("probability")
    return sized.withColumns(
        {
            "lo_pos": (F.floor(h) + 1).cast(T.LongType()),
            "hi_pos": (F.ceil(h) + 1).cast(T.LongType()),
            "frac": h - F.floor(h),
        }
    )


def _brackets(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``(column, probability, n, lo_v, hi_v, lo_pos, hi_pos, frac)``: one
    row per (column, probability), from one sketch aggregation."""
    eps = BRACKET_MARGIN / SKETCH_ACCURACY
    lows = [max(0.0, float(p) - eps) for p in probabilities]
    highs = [min(1.0, float(p) + eps) for p in probabilities]
    pcts = sorted(set(lows + highs))
    stats = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", pcts, SKETCH_ACCURACY).alias("_q"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("probability"),
                F.col("_q")[pcts.index(lo)].alias("lo_v"),
                F.col("_q")[pcts.index(hi)].alias("hi_v"),
            )
            for p, lo, hi in zip(probabilities, lows, highs)
        ]
    )
    return _positions(stats.select("column", "n", F.inline(rows)))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.5,)) -> DataFrame:
    """``(column, probability, value)``; nulls and NaN are skipped, a column
    without values has no rows."""
    values = _values(df, columns)
    brackets = F.broadcast(_brackets(values, probabilities))  # columns x probabilities rows
    v = F.col("value")
    inside = (v >= F.col("lo_v")) & (v <= F.col("hi_v"))
    keys = ["column", "probability", "lo_pos", "hi_pos", "frac"]
    counted = stored(
        values.join(brackets, "column")
        .where(v <= F.col("hi_v"))
        .groupBy(*keys, F.when(inside, v).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_cnt")),
        "quantile_counts",
    )
    below = counted.groupBy("column", "probability").agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_cnt"))), F.lit(0)).alias("_below")
    )
    scanned = value_scan(counted.where(F.col("_v").isNotNull()), "_v", ["column", "probability"], sums=["_cnt"])
    # one row per (column, probability)
    placed = scanned.join(F.broadcast(below), ["column", "probability"])
    end = F.col("_below") + F.col("cum__cnt")
    start = end - F.col("_cnt")

    def at(pos: str) -> F.Column:
        return F.max(F.when((start < F.col(pos)) & (F.col(pos) <= end), F.col("_v")))

    found = placed.groupBy("column", "probability", "frac").agg(at("lo_pos").alias("lo"), at("hi_pos").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    value = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col("frac"))
    unconfirmed = F.raise_error(F.concat(F.lit("quantile bracket not confirmed: "), F.col("column"))).cast(T.DoubleType())
    return found.select(
        "column", "probability", F.when(lo.isNotNull() & hi.isNotNull(), value).otherwise(unconfirmed).alias("value")
    )


def collect_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.5,)) -> dict[tuple[str, float], float]:
    """Quantiles as a dict (one number per column and probability: a bounded
    collect)."""
    return {(r["column"], r["probability"]): float(r["value"]) for r in exact_quantiles(df, columns, probabilities).collect()}


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, median)``: one row per column."""
    return exact_quantiles(df, columns, (0.5,)).select("column", F.col("value").alias("median"))


def collect_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians as a dict (one number per column: a bounded collect)."""
    return {c: v for (c, _), v in collect_quantiles(df, columns, (0.5,)).items()}
