"""Stored sketches, profiles per file, drift tests by kind, manifests, broken lines."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import drift_tests as D
from retentia.operators import profiles as P
from retentia.operators import sketches as S
from retentia.sources.manifest import MANIFEST, ensure_current, read_manifest
from retentia.sources.tables import load_accounts_apart


def test_merged_sketches_stay_inside_their_bound(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=30_000), np.full(15_000, 0.25)])  # a third is one value
    df = spark.createDataFrame([(float(v), None if i % 2 else float(i)) for i, v in enumerate(values)], "a double, b double")
    df = df.withColumn("k", F.monotonically_increasing_id() % 4).withColumn("c", F.lit(float("nan")))
    path = str(tmp_path / "sketches")
    for i in range(4):
        S.add_load(df.where(F.col("k") == i), ["a", "b", "c"], path, str(i))
    S.add_load(df.where(F.col("k") == 2), ["a", "b", "c"], path, "2")  # again: nothing changes
    merged = S.merged(S.read_loads(spark, path))
    assert {r.column: r.n for r in merged.collect()} == {"a": 45_000, "b": 22_500}
    data = {"a": np.sort(values), "b": np.arange(0, 45_000, 2, dtype=float)}
    for r in S.sketched_quantiles(merged, [0.1, 0.5, 0.9]).collect():
        x = data[r.column]
        below, up_to = np.searchsorted(x, r.value, "left") / len(x), np.searchsorted(x, r.value, "right") / len(x)
        assert below - S.RANK_ERROR <= r.probability <= up_to + S.RANK_ERROR


def test_psi_of_sketches(spark):
    reference = spark.range(10_000).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    current = spark.range(10_000).select((F.col("id") * 0.5).alias("a"), F.lit(1.0).alias("b"))
    sides = [S.sketch_columns(x, ["a", "b"]) for x in (reference, current)]
    same = {r.column: r.psi for r in S.sketched_psi(sides[0], sides[0]).collect()}
    assert same == pytest.approx({"a": 0.0, "b": 0.0}, abs=1e-3)
    moved = {r.column: r for r in S.sketched_psi(*sides).collect()}
    # five deciles get twice their share, five the floor
    want = 5 * 0.1 * math.log(2) + 5 * (1e-4 - 0.1) * math.log(1e-4 / 0.1)
    assert moved["a"].psi == pytest.approx(want, rel=0.15) and moved["b"].psi == 0.0
    assert len(moved["a"].buckets) == 10 and moved["a"].buckets[-1].cut is None and len(moved["b"].buckets) == 2


def test_p_values(spark):
    one = spark.range(1)
    chi = lambda x, k: one.select(D.chi_square_p_value(F.lit(float(x)), F.lit(k)).alias("p")).first().p
    # closed forms: one, two and four degrees of freedom
    for x in (0.01, 1.0, 3.84, 20.0, 60.0):
        assert chi(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=1e-12)
        assert chi(x, 2) == pytest.approx(math.exp(-x / 2), abs=1e-12)
        assert chi(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), abs=1e-12)
    assert chi(100.0, 100) == pytest.approx(0.4811, abs=2e-3) and chi(1e6, 3) == 0.0 and chi(0, 3) == 1.0 and chi(5, 0) == 1.0
    assert chi(1400.0, 1400) == pytest.approx(0.495, abs=5e-3)
    ks = lambda d, n, m: one.select(D.ks_p_value(F.lit(d), F.lit(n), F.lit(m)).alias("p")).first().p
    x = 1.2238  # the 10 % point of the limit distribution
    assert ks(x / math.sqrt(50), 100, 100) == pytest.approx(0.1, abs=1e-3)
    assert ks(0.0, 10, 10) == 1.0 and ks(1.0, 1000, 1000) == 0.0


def test_drift_tests_by_kind(spark):
    rows = lambda shift, plans: [(float(i % 50) + shift, plans[i % len(plans)], i % 2, None) for i in range(400)]
    schema = "x double, plan string, label int, empty string"
    left = spark.createDataFrame(rows(0, "aabc"), schema)
    got = {r.column: r for r in D.drift_tests(left, left, ["x", "plan", "label"], ["label"]).collect()}
    assert [got[c].kind for c in ("x", "plan", "label")] == ["number", "category", "category"]
    assert all(r.p_value == pytest.approx(1.0) and not r.drifted and r.distance == pytest.approx(0) for r in got.values())
    right = spark.createDataFrame(rows(20, "aaad"), schema)
    got = {r.column: r for r in D.drift_tests(left, right, ["x", "plan", "label", "empty"], ["label"]).collect()}
    assert set(got) == {"x", "plan", "label"}  # no value, no row
    # by hand: a 200 / 300, b 100 / 0, c 100 / 0, d 0 / 100
    assert got["plan"].statistic == pytest.approx(2 * 50**2 / 250 + 3 * 2 * 50**2 / 50)
    assert got["plan"].drifted and got["x"].drifted and not got["label"].drifted and got["plan"].p_value < 1e-9
    one_sided = D.drift_tests(left, right.where("false"), ["x", "plan"]).collect()
    assert all(r.p_value is None and r.statistic is None and not r.drifted for r in one_sided)


def test_profiles_read_new_and_changed_files_only(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "profiles")
    put = lambda name, rows: spark.createDataFrame(rows, "a string, y string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    update = lambda: P.update_profiles(spark, folder, store, ["a", "y"], "y")

    def profile():
        return {(r.measure, r.name): r.value for r in P.table_profile(P.current_profiles(spark, folder, store), ["a", "y"]).collect()}

    put("one", [("x", "1"), (None, "1.0"), ("z", "junk")])
    put("none", [])
    assert update() == 2 and update() == 0
    put("two", [("x", None), (None, "0")])
    assert update() == 1
    assert profile() == {
        ("rows", ""): 5, ("files", ""): 3, ("nulls", "a"): 2, ("nulls", "y"): 1, ("class", "1.0"): 2, ("class", "0.0"): 1,
    }
    put("one", [("x", "0")])  # another file in its place
    assert update() == 1 and profile()[("rows", "")] == 3 and profile()[("class", "0.0")] == 2


def test_tables_are_built_again_when_inputs_or_settings_change(spark, tmp_path):
    src, path, built = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(3).coalesce(1).write.parquet(src)

    def ensure(**settings):
        build = lambda: built.append(1) or spark.read.parquet(src)
        return ensure_current(spark, path, build, [src], settings)

    assert ensure(seed=1) and not ensure(seed=1)
    assert ensure(seed=2) and not ensure(seed=2)
    spark.range(4).coalesce(1).write.mode("append").parquet(src)
    assert ensure(seed=2) and spark.read.parquet(path).count() == 7
    os.unlink(f"{path}/{MANIFEST}/_SUCCESS")  # a job that ended before its manifest was whole
    assert read_manifest(spark, path) is None and ensure(seed=2) and len(built) == 4


def test_broken_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,y\n1,2,3\n2,3\n"3",4,"5,6"\n4,5,6,7\n,,\n')
    good, broken = load_accounts_apart(spark, str(tmp_path), ["id", "y"])
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("1", "3"), ("3", "5,6"), (None, None)], key=str)
    assert sorted(map(tuple, broken.collect())) == [("a.csv", "2", "2,3"), ("a.csv", "4", "4,5,6,7")]
    with pytest.raises(ValueError, match="z"):
        load_accounts_apart(spark, str(tmp_path), ["id", "z"])
