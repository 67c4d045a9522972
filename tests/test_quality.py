import json

import pytest
from pyspark.sql import functions as F

from retentia.config import DEFAULT_CONFIG
from retentia.operators import quality


def _accounts(spark, rows):
    return spark.createDataFrame(
        rows,
        "account_id long, monthly_usage_hours double, login_frequency double, last_login_days double, "
        "support_tickets double, payment_failures double, subscription_plan string, renewed int",
    )


def test_report_written_before_errors(spark, tmp_path):
    df = _accounts(spark, [(1, 1.0, None, 1.0, 1.0, 1.0, "growth", 0), (2, 1.0, 1.0, 1.0, 1.0, 1.0, "starter", 1)])
    path = str(tmp_path / "report")
    with pytest.raises(ValueError, match="login_frequency"):
        quality.check_accounts(df, DEFAULT_CONFIG, report_path=path)
    report = json.loads(spark.read.text(f"{path}/summary").first()["value"])
    assert report["row_count"] == 2 and report["null_counts"]["login_frequency"] == 1
    assert report["target_class_count"] == 2 and report["target_is_binary"]
    assert sorted(r["target_class"] for r in spark.read.json(f"{path}/target_classes").collect()) == [0, 1]


def test_missing_column_is_reported(spark, tmp_path):
    df = _accounts(spark, [(1, 1.0, 1.0, 1.0, 1.0, 1.0, "growth", 0)]).drop("support_tickets")
    with pytest.raises(ValueError, match="lacks these columns: support_tickets"):
        quality.check_accounts(df, DEFAULT_CONFIG, report_path=str(tmp_path / "r"))


def test_target_must_be_binary(spark):
    df = _accounts(spark, [(1, 1.0, 1.0, 1.0, 1.0, 1.0, "growth", 1)])
    with pytest.raises(ValueError, match="must take the values 0 and 1"):
        quality.check_accounts(df, DEFAULT_CONFIG)


def test_contract_violations_and_quarantine(spark):
    df = _accounts(spark, [(1, -1.0, 1.0, 1.0, 1.0, 1.0, "growth", 0), (2, 1.0, 1.0, 1.0, 1.0, 1.0, "ab", 1),
                           (3, 1.0, 1.0, 1.0, 1.0, 1.0, "business", 1)])
    got = {r["account_id"]: (r["violations"], r["is_valid"]) for r in quality.contract_violations(df).collect()}
    assert got[1] == ("monthly_usage_hours:negative", False)
    assert got[2] == ("subscription_plan:length", False)
    assert got[3] == ("", True)
    good, bad = quality.split_by_contract(df)
    assert [r["account_id"] for r in good.collect()] == [3] and bad.count() == 2


def test_unexpected_columns():
    class Fake:
        columns = ["monthly_usage_hours", "unexpected"]

    assert quality.unexpected_columns(Fake(), list(DEFAULT_CONFIG.input_features)) == ["unexpected"]


def test_text_targets_are_parsed_like_inputs(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(["1", "0", "1d", "1.0", " 0 ", "nan", None, "yes"])]
    df = spark.createDataFrame(rows, "account_id long, renewed string")
    assert [r[0] for r in quality.target_classes(df, "renewed").collect()] == [0.0, 1.0]
    profile = quality.validation_profile(df).first()
    assert profile["target_class_count"] == 2 and profile["binary_target"]


def test_any_number_of_classes_is_reported(spark, tmp_path):
    df = spark.range(40).select(
        F.col("id").alias("account_id"),
        *[F.lit(1.0).alias(c) for c in DEFAULT_CONFIG.input_features if c != "subscription_plan"],
        F.lit("growth").alias("subscription_plan"),
        F.col("id").cast("int").alias("renewed"),
    )
    with pytest.raises(ValueError, match="values 0 and 1"):
        quality.check_accounts(df, DEFAULT_CONFIG, report_path=str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "target_classes")).count() == 40
