import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.config import MODEL_FEATURES
from retentia.operators import drift as D
from retentia.operators import explain as E


def _features(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    data = {f: np.round(rng.normal(size=n), 2) for f in MODEL_FEATURES}
    data["account_id"] = np.arange(n)
    pdf = pd.DataFrame(data)
    return spark.createDataFrame(pdf), pdf


def test_contributions_and_top_factors_match_pandas(spark):
    df, pdf = _features(spark)
    imp = tuple(float(i + 1) / 10 for i in range(len(MODEL_FEATURES)))
    basis = E.fit_basis(df, imp)
    med = pdf[list(MODEL_FEATURES)].median()
    for f in MODEL_FEATURES:
        assert basis.baseline(f) == pytest.approx(med[f], abs=1e-12)
    top = E.top_factors(df, basis, 5).toPandas()
    for acc in (0, 17, 299):
        row = pdf.iloc[acc]
        contrib = [((row[f] - med[f]) * imp[i], i, f) for i, f in enumerate(MODEL_FEATURES)]
        expected = sorted(contrib, key=lambda c: (-abs(c[0]), c[1]))[:5]
        got = top[top.account_id == acc].sort_values("rank")
        assert list(got.feature) == [c[2] for c in expected]
        assert np.allclose(got.contribution, [c[0] for c in expected])


def test_ties_keep_feature_order(spark):
    df, _ = _features(spark, 5)
    basis = E.ExplanationBasis(tuple(MODEL_FEATURES), tuple((f, 0.0) for f in MODEL_FEATURES), tuple([1.0] * 12))
    flat = df.select("account_id", *[F.lit(1.0).alias(f) for f in MODEL_FEATURES])
    got = E.top_factors(flat, basis, 3).where("account_id = 0").orderBy("rank").toPandas()
    assert list(got.feature) == list(MODEL_FEATURES[:3])


def test_global_importance(spark):
    df, pdf = _features(spark)
    basis = E.fit_basis(df, None)
    got = {r["feature"]: r["mean_abs_contribution"] for r in E.global_importance(df, basis).collect()}
    for f in MODEL_FEATURES:
        assert got[f] == pytest.approx((pdf[f] - basis.baseline(f)).abs().mean(), abs=1e-12)


def _brute_drift(a, b, buckets=10):
    xs = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    ks = np.abs(fa - fb).max()
    w1 = (np.abs(fa - fb)[:-1] * np.diff(xs)).sum()
    sa = np.sort(a)
    below = lambda v: np.searchsorted(sa, v, side="left")
    bucket_a = np.minimum(buckets - 1, (buckets * below(a)) // len(a))
    bucket_b = np.minimum(buckets - 1, (buckets * below(b)) // len(a))
    pa = np.bincount(bucket_a, minlength=buckets) / len(a)
    pb = np.bincount(bucket_b, minlength=buckets) / len(b)
    pa, pb = np.maximum(pa, 1e-4), np.maximum(pb, 1e-4)
    psi = ((pb - pa) * np.log(pb / pa)).sum()
    return ks, w1, psi


def test_distribution_drift_matches_numpy(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(0, 1, 800), 2), np.round(rng.normal(0.3, 1.2, 500), 2)
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    got = D.distribution_drift(ref, cur, ["x"]).first()
    ks, w1, psi = _brute_drift(a, b)
    assert got["ks_statistic"] == pytest.approx(ks, abs=1e-12)
    assert got["wasserstein"] == pytest.approx(w1, abs=1e-9)
    assert got["psi"] == pytest.approx(psi, abs=1e-9)
    assert got["drifted"] == bool(psi > 0.2 or ks > 0.1)


def test_mean_delta_skips_nan(spark):
    ref = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    cur = spark.createDataFrame([(4.0,)], "x double")
    got = D.mean_delta(ref, cur, ["x"]).first()
    assert (got["reference_mean"], got["current_mean"], got["mean_delta"]) == (2.0, 4.0, 2.0)


def test_drift_of_an_empty_side_is_null(spark):
    from retentia.operators import drift as D

    a = spark.createDataFrame([(float(i), None, float(i)) for i in range(20)], "x double, y double, z double")
    b = spark.createDataFrame([(None, float(i), float(i) + 9) for i in range(20)], "x double, y double, z double")
    got = {r["column"]: r for r in D.distribution_drift(a, b, ["x", "y", "z"]).collect()}
    for c in ("x", "y"):
        assert got[c]["psi"] is None and got[c]["ks_statistic"] is None and got[c]["drifted"] is None
    assert got["z"]["drifted"]
    summary = D.drift_summary(D.distribution_drift(a, b, ["x", "y", "z"]), a, b).first()
    assert summary["n_columns"] == 3 and summary["n_drifted"] == 1
    nothing = D.distribution_drift(a.select("y"), a.select("y"), ["y"])
    assert D.drift_summary(nothing, a, b).first()["share_drifted"] is None
