from pyspark.sql import Window as W
from pyspark.sql import functions as F

import retentia.operators.prefix as P


def _check(df, groups, sums):
    res = P.value_scan(df, "k", groups, sums=sums, lead=True, rank="rn")
    w = W.partitionBy(*groups).orderBy("k") if groups else W.orderBy("k")
    ref = df.select("id", F.row_number().over(w).alias("ref_rn"), F.lead("k").over(w).alias("ref_next"),
                    *[F.sum(s).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"ref_{s}") for s in sums])
    j = res.join(ref, "id")
    bad = (F.col("rn") != F.col("ref_rn")) | ~F.col("next_k").eqNullSafe(F.col("ref_next"))
    for s in sums:
        bad = bad | (F.abs(F.col(f"cum_{s}") - F.col(f"ref_{s}")) > 1e-6)
    assert res.count() == df.count()
    assert j.where(bad).count() == 0


def test_value_scan_matches_windows_with_hot_group(spark, monkeypatch):
    # one group holds two thirds of the rows; many buckets, some empty
    monkeypatch.setattr(P, "BUCKET_ROWS", 20)
    df = spark.range(0, 3000).select(
        F.col("id"),
        F.when(F.col("id") < 2000, F.lit("hot")).otherwise((F.col("id") % 3).cast("string")).alias("g"),
        (F.col("id") * 7919 % 100003 + F.col("id") / 1e6).alias("k"),
        (F.col("id") % 5).alias("v"), (F.col("id") / 3.0).alias("x"))
    _check(df, ["g"], ["v", "x"])
    _check(df, ["g"], ["v"])
    monkeypatch.setattr(P, "BUCKET_ROWS", 200_000)  # one bucket per group
    _check(df, ["g"], ["v"])


def test_value_scan_without_groups_and_tiny_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 10)
    df = spark.range(0, 1000).select(F.col("id"), (-F.col("id") / 7.0).alias("k"), (F.col("id") % 7).alias("v"))
    _check(df, [], ["v"])
    tiny = spark.range(0, 5).select(F.col("id"), (F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("k"),
                                    F.lit(1).alias("v"))
    _check(tiny, ["g"], ["v"])


def test_value_scan_coarse_sketch(spark, monkeypatch):
    monkeypatch.setattr(P, "SKETCH_ACCURACY", 50)
    monkeypatch.setattr(P, "BUCKET_ROWS", 30)
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 2).alias("g"),
                                     F.sin(F.col("id")).alias("k"), F.lit(1).alias("v"))
    _check(df, ["g"], ["v"])


def test_value_scan_through_a_deep_tree_of_cuts(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 20)
    monkeypatch.setattr(P, "FAN_OUT", 4)
    monkeypatch.setattr(P, "BROADCAST_CUTS", 3)
    df = spark.range(0, 3000).select(
        F.col("id"),
        F.when(F.col("id") < 2900, F.lit("hot")).otherwise((F.col("id") % 3).cast("string")).alias("g"),
        F.pow(F.col("id") * 7919 % 100003, F.lit(3)).alias("k"),
        (F.col("id") % 5).alias("v"))
    deep = P._bucketed(df, "k", ["g"])
    assert deep.select("g", P.BUCKET).distinct().count() > 2900 / 20
    assert deep.groupBy("g", P.BUCKET).count().where("count > 20").count() == 0
    _check(df, ["g"], ["v"])
    _check(df, [], ["v"])
