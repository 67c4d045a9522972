"""Drift tests by kind of column.

Numbers are compared by the two-sample Kolmogorov-Smirnov test, categories by
the chi-square test of their contingency table (side x category) and by the
Jensen-Shannon distance of the two distributions. The kind follows from the
declared type of a column (text and booleans are categories; numbers can be
named as such), never from the number of rows, so a column is tested alike at
every size. Both p-values are their series, folded as column expressions over
one row per column: everything runs inside the JVM.

Counts come from one aggregation over both sides; a category held by a third
of all rows is one row per map task.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .drift import CURRENT, REFERENCE, SIDE, distribution_drift

NUMBER, CATEGORY = "number", "category"
#: A column has drifted if its p-value is below this (our choice, like the
#: thresholds of the distances).
P_VALUE = 0.05
KS_TERMS = 100
#: Terms of the chi-square series beyond the statistic itself.
MORE_TERMS = 100


def column_kind(df: DataFrame, column: str, categories: Sequence[str] = ()) -> str:
    if column in categories:
        return CATEGORY
    return CATEGORY if isinstance(df.schema[column].dataType, (T.StringType, T.BooleanType)) else NUMBER


def ks_p_value(statistic: Column, n_reference: Column, n_current: Column) -> Column:
    """2 * sum of (-1)^(k-1) exp(-2 k^2 x^2), x the statistic times the root
    of n m / (n + m). The series needs few terms; below x = 0.2, where it
    would need many, the value is one to ten digits."""
    n, m = n_reference.cast("double"), n_current.cast("double")
    x = statistic * F.sqrt(n * m / (n + m))

    def term(total: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return total + sign * F.exp(F.lit(-2.0) * k * k * x * x)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), term)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def chi_square_p_value(statistic: Column, freedom: Column) -> Column:
    """The upper tail of the chi-square distribution: one less the series
    z^a e^-z / G(a + 1) * (1 + z / (a+1) + z^2 / ((a+1)(a+2)) + ...), with
    a = freedom / 2 and z = statistic / 2. Far out, where the tail is below
    any double's share of one, it is 0. For up to 2,000 degrees of freedom;
    1 where there is no freedom."""
    a, z = freedom.cast("double") / 2, statistic / 2
    whole = (freedom % 2 == 0).cast("double")
    # ln G(a + 1): the product down to 1, or to one half times the root of pi
    start = F.when(whole == 1, F.lit(0.0)).otherwise(F.lit(math.log(math.pi) / 2))
    steps = F.sequence(F.lit(0), F.ceil(a).cast("int") - 1)
    ln_gamma = F.aggregate(steps, start, lambda total, k: total + F.log(a - k))

    def term(acc: Column, k: Column) -> Column:
        following = acc["term"] * z / (a + k)
        return F.struct(following.alias("term"), (acc["total"] + following).alias("total"))

    first = F.exp(a * F.log(z) - z - ln_gamma)
    far = z > a + 50 * F.sqrt(a) + MORE_TERMS
    terms = F.when(far, F.lit(1)).otherwise((F.ceil(z) + MORE_TERMS).cast("int"))
    lower = F.aggregate(F.sequence(F.lit(1), terms), F.struct(first.alias("term"), first.alias("total")), term, lambda acc: acc["total"])
    p = F.when(far, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - lower))
    return F.when((freedom < 1) | (z <= 0), F.lit(1.0)).otherwise(p)


def category_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, ref_cnt, cur_cnt); a null is no category."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("category")) for c in columns])
    sides = reference.select(F.lit(REFERENCE).alias(SIDE), F.inline(pairs)).unionByName(
        current.select(F.lit(CURRENT).alias(SIDE), F.inline(pairs))
    )
    return (
        sides.where(F.col("category").isNotNull())
        .groupBy("column", "category")
        .agg(F.count_if(F.col(SIDE) == REFERENCE).alias("ref_cnt"), F.count_if(F.col(SIDE) == CURRENT).alias("cur_cnt"))
    )


def category_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, statistic, distance, p_value): chi-square and Jensen-Shannon
    distance (in bits: from 0 to 1). Null where a side has no value."""
    counts = category_counts(reference, current, columns)
    # a row per (column, category) of each column's distinct values: partial sums first
    sizes = counts.groupBy("column").agg(
        F.sum("ref_cnt").cast("double").alias("n_ref"), F.sum("cur_cnt").cast("double").alias("n_cur"), F.count(F.lit(1)).alias("categories")
    )
    rows = counts.join(F.broadcast(sizes), "column")  # one row per column
    ref, cur, n_ref, n_cur = F.col("ref_cnt").cast("double"), F.col("cur_cnt").cast("double"), F.col("n_ref"), F.col("n_cur")
    total, share = n_ref + n_cur, (ref + cur) / (n_ref + n_cur)
    both = (n_ref > 0) & (n_cur > 0)
    chi = F.try_divide((ref - n_ref * share) ** 2, n_ref * share) + F.try_divide((cur - n_cur * share) ** 2, n_cur * share)
    p, q = F.try_divide(ref, n_ref), F.try_divide(cur, n_cur)
    middle = (p + q) / 2

    def towards(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))

    sums = rows.groupBy("column", "n_ref", "n_cur", "categories").agg(
        F.sum(F.when(both, chi)).alias("statistic"), F.sum(F.when(both, (towards(p) + towards(q)) / 2)).alias("divergence")
    )
    return sums.select(
        "column",
        "statistic",
        F.sqrt(F.greatest(F.lit(0.0), "divergence")).alias("distance"),
        F.when(both, chi_square_p_value(F.col("statistic"), F.col("categories") - 1)).alias("p_value"),
    )


def number_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, statistic, distance, p_value): the KS statistic, the
    Wasserstein distance, and the test's p-value."""
    drift = distribution_drift(reference, current, columns)

    def sizes(df: DataFrame, name: str) -> DataFrame:
        present = [F.count_if(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))).alias(f"n{i}") for i, c in enumerate(columns)]
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(name)) for i, c in enumerate(columns)])
        return df.agg(*present).select(F.inline(rows))

    # one row per column on every side of the joins
    joined = drift.join(sizes(reference, "n_ref"), "column").join(sizes(current, "n_cur"), "column")
    p = ks_p_value(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))
    return joined.select(
        "column",
        F.col("ks_statistic").alias("statistic"),
        F.col("wasserstein").alias("distance"),
        F.when(F.col("ks_statistic").isNotNull(), p).alias("p_value"),
    )


def drift_tests(reference: DataFrame, current: DataFrame, columns: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """(column, kind, test, statistic, distance, p_value, drifted) of every
    column; numbers named in ``categories`` (labels, codes) are categories.
    Statistics are null where a side has no value; such a column has not
    drifted. A column without any value has no row."""
    kinds = {c: column_kind(reference, c, categories) for c in columns}
    parts = []
    for kind, test, of in ((NUMBER, "ks", number_drift), (CATEGORY, "chi_square", category_drift)):
        chosen = [c for c in columns if kinds[c] == kind]
        if chosen:
            parts.append(of(reference, current, chosen).select("column", F.lit(kind).alias("kind"), F.lit(test).alias("test"), "statistic", "distance", "p_value"))
    if not parts:
        raise ValueError("no columns to test")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("drifted", F.coalesce(F.col("p_value") < P_VALUE, F.lit(False)))
