import pytest
from pyspark.sql import functions as F

from retentia.config import DEFAULT_CONFIG, MODEL_FEATURES
from retentia.plans import training as TR
from retentia.plans.catalog import split_features
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def bundle_and_split(spark, tmp_path_factory):
    split = split_features(spark, SF_SMALL)
    cfg = DEFAULT_CONFIG.with_(gbt_ranges=(("n_estimators", (10, 15)),) + DEFAULT_CONFIG.gbt_ranges[1:])
    path = str(tmp_path_factory.mktemp("bundle") / "model")
    bundle = TR.fit_and_evaluate(split, cfg, n_trials=2, bundle_path=path)
    return bundle, split, path, cfg


def test_training_reports_metrics(bundle_and_split):
    bundle, _, _, _ = bundle_and_split
    m = bundle.metrics
    assert 0.0 <= m["roc_auc"] <= 1.0 and 0.0 <= m["average_precision"] <= 1.0
    assert m["n_trials"] == 2 and 0.0 <= m["best_cv_score"] <= 1.0
    cm = m["confusion_matrix"]
    assert sum(map(sum, cm)) == m["classification_report"]["accuracy"]["support"]
    assert set(bundle.best_params) == {"n_estimators", "learning_rate", "max_depth", "min_samples_split",
                                       "min_samples_leaf", "subsample", "max_features"}


def test_bundle_roundtrip_and_publish(spark, bundle_and_split, tmp_path):
    bundle, split, path, cfg = bundle_and_split
    loaded = TR.load_bundle(spark, path)
    assert loaded.metadata["feature_names"] == list(MODEL_FEATURES)
    assert set(loaded.metadata["training_feature_medians"]) == set(MODEL_FEATURES)
    dest = TR.publish_bundle(spark, path, str(tmp_path / "serving"))
    served = TR.load_bundle(spark, dest)
    a = TR.score(bundle, split, cfg).select("account_id", "renewal_probability")
    b = TR.score(served, split, cfg).select("account_id", "renewal_probability")
    assert a.exceptAll(b).count() == 0


def test_scores_in_range_and_labels(bundle_and_split):
    bundle, split, _, cfg = bundle_and_split
    out = TR.score(bundle, split, cfg)
    bad = out.where((F.col("renewal_probability") < 0) | (F.col("renewal_probability") > 1))
    assert bad.count() == 0
    labels = {r[0] for r in out.select("renewal_label").distinct().collect()}
    assert labels <= {"renewed", "not_renewed"}
    mism = out.where((F.col("renewal_probability") >= 0.5) != (F.col("renewal_prediction") == 1))
    assert mism.count() == 0


def test_missing_bundle_raises(spark, tmp_path):
    with pytest.raises(TR.NoBundle):
        TR.load_bundle(spark, str(tmp_path / "nothing"))


def test_default_params_and_mapping():
    p = TR.default_params(DEFAULT_CONFIG)
    assert p == {"n_estimators": 80, "learning_rate": 0.03, "max_depth": 2, "min_samples_split": 2,
                 "min_samples_leaf": 1, "subsample": 0.7, "max_features": "sqrt"}
    s = TR.gbt_settings(p, 111)
    assert s["maxIter"] == 80 and s["minInstancesPerNode"] == 1 and s["featureSubsetStrategy"] == "sqrt"
    draws = TR.sample_params(DEFAULT_CONFIG, 5, 111)
    assert draws == TR.sample_params(DEFAULT_CONFIG, 5, 111)
    for d in draws:
        assert 80 <= d["n_estimators"] <= 220 and 0.03 <= d["learning_rate"] <= 0.25


def _signal(spark, n=1200):
    """Accounts whose label follows their numbers."""
    r = lambda seed, top: F.floor(F.rand(seed) * top)
    base = spark.range(n).select(
        F.col("id").alias("account_id"),
        r(1, 60).alias("monthly_usage_hours"),
        r(2, 25).alias("login_frequency"),
        r(3, 30).alias("last_login_days"),
        r(4, 5).alias("support_tickets"),
        r(5, 4).alias("payment_failures"),
        F.lit("growth").alias("subscription_plan"),
    )
    good = F.col("login_frequency") - F.col("last_login_days") - 3 * F.col("payment_failures") + 4 * F.randn(6) > -5
    from retentia.operators.features import account_features

    return account_features(base.withColumn("renewed", good.cast("int")))


SMALL = DEFAULT_CONFIG.with_(gbt_ranges=(("n_estimators", (20, 25)),) + DEFAULT_CONFIG.gbt_ranges[1:])


@pytest.fixture(scope="module")
def signal(spark):
    from retentia.operators.split import stratified_split

    return stratified_split(_signal(spark))


def test_model_finds_signal(signal):
    bundle = TR.fit_and_evaluate(signal, SMALL, n_trials=1)
    assert bundle.metrics["roc_auc"] > 0.8 and bundle.metrics["best_cv_score"] > 0.8


def test_positive_class_zero_is_the_other_way_round(signal):
    cfg = SMALL.with_(positive_class=0)
    bundle = TR.fit_and_evaluate(signal, cfg, n_trials=1)
    assert bundle.metrics["roc_auc"] > 0.8
    scored = TR.score(bundle, signal.where("split = 'test'"), cfg, ("account_id", "renewed"))
    means = {r["renewed"]: r["p"] for r in scored.groupBy("renewed").agg(F.avg("renewal_probability").alias("p")).collect()}
    assert means[0] > 0.5 > means[1]


def test_model_does_not_depend_on_the_layout(spark, signal):
    train = signal.where("split = 'train'")
    scores = []
    for other in (train.coalesce(1), train.repartition(7, "login_frequency")):
        table = TR.materialized_training_table(other, SMALL)
        pipeline, gbt = TR.build_pipeline(SMALL)
        model = pipeline.fit(table, params=TR.param_map(gbt, TR.default_params(SMALL), SMALL.random_state))
        bundle = TR.Bundle(model, {})
        scores.append({r[0]: r[1] for r in TR.score(bundle, signal, SMALL).select("account_id", "renewal_probability").collect()})
    assert scores[0] == scores[1]


def test_model_without_probabilities(spark):
    class Labels:
        def transform(self, df):
            return df.withColumn("prediction", (F.col("login_frequency") > 10).cast("double"))

    df = _signal(spark, 50)
    out = TR.score(TR.Bundle(Labels(), {}), df, SMALL, ("account_id",))
    assert {r[0] for r in out.select("renewal_probability").collect()} == {0.0, 1.0}
    assert out.where((F.col("login_frequency") > 10) != (F.col("renewal_prediction") == 1)).count() == 0


def test_input_columns_come_back_as_they_are(spark, bundle_and_split):
    bundle, _, _, cfg = bundle_and_split
    rows = spark.createDataFrame(
        [("a", "12", "x", "3", "1", "0", " Growth", "keep")],
        "account_id string, monthly_usage_hours string, login_frequency string, last_login_days string, "
        "support_tickets string, payment_failures string, subscription_plan string, risk_score string",
    )
    out = TR.score_accounts(bundle, rows, cfg)
    assert out.columns == [*rows.columns, "renewal_probability", "renewal_prediction", "renewal_label"]
    assert tuple(out.first())[:8] == tuple(rows.first())


def test_explanations_of_a_fitted_model(spark, bundle_and_split):
    bundle, split, _, cfg = bundle_and_split
    row = split.where("account_id IS NOT NULL").orderBy("account_id").first()
    record = TR.explain_accounts(bundle, split.where(F.col("account_id") == row["account_id"]), cfg).first()
    medians, weights = bundle.metadata["training_feature_medians"], bundle.metadata["feature_importances"]
    want = [(f, row[f], (row[f] - medians[f]) * weights[f]) for f in MODEL_FEATURES]
    want.sort(key=lambda x: -abs(x[2]))  # stable: ties in feature order
    got = [(x["feature"], x["feature_value"], x["shap_value"]) for x in record["top_factors"]]
    assert [g[0] for g in got] == [w[0] for w in want[: cfg.top_k]]
    assert all(abs(g[2] - w[2]) < 1e-9 and g[1] == w[1] for g, w in zip(got, want))
    assert record["base_value"] is None and record["explanation_backend"] == "feature_importance_fallback"


def test_fitted_model_scores_a_stream(spark, bundle_and_split, tmp_path):
    bundle, split, _, cfg = bundle_and_split
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    split.drop("split").repartition(2).write.parquet(src)
    stream = spark.readStream.schema(split.drop("split").schema).parquet(src)
    query = TR.score(bundle, stream, cfg).writeStream.option("checkpointLocation", str(tmp_path / "ck"))
    query.trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    batch = TR.score(bundle, spark.read.parquet(src), cfg)
    streamed = spark.read.parquet(out).select(*batch.columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_a_version_without_metadata_is_not_served(spark, bundle_and_split, tmp_path):
    import shutil

    bundle, _, _, _ = bundle_and_split
    path = str(tmp_path / "bundle")
    first, second = TR.save_bundle(bundle, path), TR.save_bundle(bundle, path)
    assert TR._versions(spark, path) == [first, second]
    shutil.rmtree(f"{second}/metadata")
    assert TR._versions(spark, path) == [first]
    assert TR.load_bundle(spark, path).metadata["feature_names"] == list(MODEL_FEATURES)


def test_configured_cv_metric():
    from retentia.config import RenewalConfig

    assert RenewalConfig.from_dict({"training": {"scoring": "average_precision"}}).cv_metric == "average_precision"
    with pytest.raises(ValueError, match="unknown training metric"):
        TR.cross_validate(None, [], RenewalConfig.from_dict({"training": {"scoring": "other"}}))
