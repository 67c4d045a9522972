"""A stored table of quantile sketches, one per column and load.

Medians and decile shares of a growing table, without reading old rows again:
each load is sketched once (a KLL sketch per column, in the JVM, partial
aggregation) and appended to the table; quantiles come from the merged
sketches. A load is a partition that is replaced as a whole, so sketching it
again changes nothing.

Ranks are approximate: with ``SKETCH_K`` a quantile's rank is within
``RANK_ERROR`` of the asked one with more than 99 % certainty, before and
after merging. Where an exact value is needed use ``operators.quantiles``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, PSI_FLOOR, RenewalConfig
from .quantiles import long_form

#: Size of a sketch and the rank error that goes with it, as a share of the
#: values (about 2.3 / k^0.9 for one quantile at 99 %; doubled here).
SKETCH_K = 1_600
RANK_ERROR = 0.006
LOAD = "load"


def sketch_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, sketch): nulls and NaN are left out; a column without
    values has no row."""
    values = long_form(df, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return values.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("sketch")
    )


def add_load(df: DataFrame, columns: Sequence[str], path: str, load: str) -> None:
    """Sketch ``df`` and put the sketches into the table at ``path`` as the
    load of that name, in place of an earlier one of the same name."""
    made = sketch_columns(df, columns).coalesce(1)  # one row per column
    made.write.mode("overwrite").parquet(f"{path}/{LOAD}={load}")


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """(column, n, sketch, load) of all loads."""
    schema = f"column string, n bigint, sketch binary, {LOAD} string"
    return spark.read.schema(schema).parquet(path)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, sketch) over all loads."""
    return sketches.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probabilities: Sequence[float] = (0.5,)) -> DataFrame:
    """(column, probability, value) of merged sketches."""
    rows = F.array(
        *[F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probabilities]
    )
    return sketches.select("column", F.inline(rows))


def sketched_medians(sketches: DataFrame) -> DataFrame:
    """(column, median): the approximate form of ``exact_medians``."""
    return sketched_quantiles(sketches).select("column", F.col("value").alias("median"))


def sketched_psi(reference: DataFrame, current: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """(column, buckets, psi) of two merged sketch tables. Buckets are cut at
    the reference's deciles, each holds the values up to its cut; equal cuts
    are one. ``buckets``: (cut, p_ref, p_cur), the last cut null. A column has
    a row if both sides do."""
    steps = config.psi_buckets
    cuts: dict[str, set[float]] = {}
    # nine numbers a column; ranks are asked for constants only
    for r in sketched_quantiles(reference, [i / steps for i in range(1, steps)]).collect():
        cuts.setdefault(r["column"], set()).add(r["value"])
    both = reference.select("column", F.col("sketch").alias("ref")).join(
        current.select("column", F.col("sketch").alias("cur")), "column"
    )  # a row per column on either side

    def rank(side: str, cut: float) -> Column:
        return F.kll_sketch_get_rank_double(side, F.lit(cut))

    def bucket(below: float | None, cut: float | None) -> Column:
        share = {s: (rank(s, cut) if cut is not None else F.lit(1.0)) - (rank(s, below) if below is not None else F.lit(0.0)) for s in ("ref", "cur")}
        return F.struct(F.lit(cut).cast("double").alias("cut"), share["ref"].alias("p_ref"), share["cur"].alias("p_cur"))

    buckets = F.lit(None)
    for column, found in cuts.items():
        ends = [None, *sorted(found), None]
        buckets = F.when(F.col("column") == column, F.array(*map(bucket, ends, ends[1:]))).otherwise(buckets)

    def term(total: Column, x: Column) -> Column:
        p, q = F.greatest(x["p_ref"], F.lit(PSI_FLOOR)), F.greatest(x["p_cur"], F.lit(PSI_FLOOR))
        return total + (q - p) * F.log(q / p)

    kind = "array<struct<cut: double, p_ref: double, p_cur: double>>"
    return both.select("column", buckets.cast(kind).alias("buckets")).withColumn("psi", F.aggregate("buckets", F.lit(0.0), term))
