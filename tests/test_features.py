import math

import pytest
from pyspark.sql import types as T

from retentia.config import MODEL_FEATURES, RenewalConfig
from retentia.operators.features import account_features, coerce_inputs, model_frame, normalize_plans

NUM = ["monthly_usage_hours", "login_frequency", "last_login_days", "support_tickets", "payment_failures"]
SCHEMA = T.StructType(
    [T.StructField("account_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in NUM]
    + [T.StructField("subscription_plan", T.StringType())]
)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_sample_account_features(spark):
    out = account_features(frame(spark, [(1, 42.0, 18.0, 2.0, 1.0, 0.0, "business")])).first()
    assert out["engagement_score"] == 14.0
    assert out["activity_ratio"] == pytest.approx(18 / 43)
    assert out["support_pressure"] == pytest.approx(1 / 19)
    assert out["payment_reliability"] == 1.0
    assert out["usage_momentum"] == pytest.approx(42 * math.log(19))
    assert out["plan_value_index"] == 1.3
    assert out["risk_score"] == 0.0  # raw risk is negative, clipped


def test_high_risk_scenario_risk_score(spark):
    out = account_features(frame(spark, [(1, 8.0, 4.0, 21.0, 4.0, 2.0, "starter")])).first()
    assert out["risk_score"] == 7.6659


def test_output_order_passthrough_first(spark):
    out = account_features(frame(spark, [(1, 1.0, 1.0, 1.0, 1.0, 1.0, "growth")]))
    assert out.columns == ["account_id"] + list(MODEL_FEATURES)


@pytest.mark.parametrize(
    "raw,expected",
    [(None, "growth"), ("", "growth"), (" Growth ", "growth"), ("\tbusiness\t", "business"), ("unknown", "growth"),
     ("STARTER", "starter"), ("Enterprise\n", "enterprise"), ("nan", "growth"), ("  ", "growth")],
)
def test_plan_normalization(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "subscription_plan string")
    assert normalize_plans(df).first()["subscription_plan"] == expected


def test_numeric_coercion_from_text(spark):
    # what a pandas numeric parse accepts, and 0.0 for everything else
    cases = [(" 5 ", 5.0), ("1d", 0.0), ("1e3", 1000.0), ("NaN", 0.0), ("", 0.0), ("abc", 0.0), ("1,000", 0.0),
             ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("0x10", 0.0), (None, 0.0), ("1.5e-3", 0.0015)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "monthly_usage_hours string")
    got = [r[0] for r in coerce_inputs(df, ["monthly_usage_hours"]).collect()]
    assert got == [e for _, e in cases]
    inf = coerce_inputs(spark.createDataFrame([("inf",), ("-Infinity",)], "monthly_usage_hours string"), ["monthly_usage_hours"])
    assert [r[0] for r in inf.collect()] == [float("inf"), float("-inf")]


def test_numeric_coercion_null_and_nan(spark):
    df = frame(spark, [(1, None, float("nan"), 3.0, None, None, None)])
    out = account_features(df).first()
    assert out["monthly_usage_hours"] == 0.0 and out["login_frequency"] == 0.0
    assert out["plan_value_index"] == 1.0  # null plan -> growth


def test_negative_inputs_do_not_fail(spark):
    # pandas would give inf; ANSI Spark would raise: we give null instead
    out = account_features(frame(spark, [(1, -1.0, 2.0, 3.0, 0.0, 0.0, "growth")])).first()
    assert out["activity_ratio"] is None


def test_custom_plan_map_missing_plan_is_null(spark):
    cfg = RenewalConfig.from_dict({"feature_engineering": {"plan_scores": {"starter": 0.5, "growth": 1.0}}})
    out = account_features(frame(spark, [(1, 1.0, 1.0, 1.0, 1.0, 1.0, "business")]), cfg).first()
    assert out["plan_value_index"] is None


def test_config_accepts_feature_section_only():
    cfg = RenewalConfig.from_dict({"inactivity_risk_weight": 0.5})
    assert cfg.inactivity_risk_weight == 0.5 and cfg.payment_failure_risk_weight == 1.75


def test_bypass_when_features_present(spark):
    feats = account_features(frame(spark, [(1, 42.0, 18.0, 2.0, 1.0, 0.0, "business")]))
    again = model_frame(feats, keep=["account_id"])
    assert again.columns == ["account_id"] + list(MODEL_FEATURES)
    assert again.first().asDict() == feats.select("account_id", *MODEL_FEATURES).first().asDict()


def test_missing_raw_inputs_are_named(spark):
    df = spark.createDataFrame([(1.0,)], "monthly_usage_hours double")
    with pytest.raises(ValueError, match="login_frequency.*subscription_plan"):
        model_frame(df)


def test_scenario_rows_follow_accounts(spark):
    from retentia.operators.scoring import apply_scenarios, scenario_inputs

    accounts = frame(spark, [(1, 42.0, 18.0, 2.0, 1.0, 0.0, "business"), (2, 8.0, 4.0, 21.0, 4.0, 2.0, "starter")])
    rows = apply_scenarios(accounts, scenario_inputs(spark, accounts)).collect()
    profiles = [r["profile"] for r in rows]
    assert profiles.count("account") == 2 and "default" in profiles and len(rows) == 2 + len(set(profiles) - {"account"})
    default = next(r for r in rows if r["profile"] == "default")
    assert default["monthly_usage_hours"] == 25.0 and default["account_id"] is None  # median of 42 and 8
    built = account_features(apply_scenarios(accounts, scenario_inputs(spark, accounts)))
    assert built.count() == len(rows)
