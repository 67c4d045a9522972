import json
import os

import pytest

from retentia.plans import jobs
from conftest import SF_SMALL


def test_pipeline_stages_end_to_end(spark, tmp_path):
    out = str(tmp_path / "run")
    cfg_path = tmp_path / "params.json"
    cfg_path.write_text(json.dumps({"gradient_boosting": {
        "n_estimators": [5, 8], "learning_rate": [0.03, 0.25], "max_depth": [2, 3], "min_samples_split": [2, 18],
        "min_samples_leaf": [1, 8], "subsample": [0.7, 1.0], "max_features": ["sqrt", "log2", "null"]}}))
    cfg = jobs.load_config(str(cfg_path), spark)
    assert jobs.stage_features(spark, SF_SMALL, out, cfg, "tables") and jobs.stage_split(spark, out, cfg)
    # a second run leaves the tables alone, other settings of the split do not
    assert not jobs.stage_features(spark, SF_SMALL, out, cfg, "tables") and not jobs.stage_split(spark, out, cfg)
    assert jobs.stage_split(spark, out, cfg.with_(random_state=5)) and jobs.stage_split(spark, out, cfg)
    splits = spark.read.parquet(f"{out}/splits")
    assert {r[0] for r in splits.select("split").distinct().collect()} == {"train", "test"}
    metrics = jobs.stage_train(spark, out, cfg, n_trials=1)
    assert 0 <= metrics["roc_auc"] <= 1
    served = jobs.stage_publish(spark, out, str(tmp_path / "serving"))
    assert os.path.isdir(served)
    jobs.stage_drift(spark, out, cfg)
    summary = spark.read.json(f"{out}/reports/drift/summary").first()
    assert summary["n_columns"] == 14 and summary["reference_rows"] + summary["current_rows"] == splits.count()
    jobs.stage_score(spark, SF_SMALL, out, cfg, "tables")
    scored = spark.read.option("header", True).csv(f"{out}/scored")
    assert scored.count() == splits.count() and "risk_segment" in scored.columns


    # an unlabelled CSV: the input rows come back with their predictions
    path = tmp_path / "new.csv"
    path.write_text(
        "monthly_usage_hours,login_frequency,last_login_days,support_tickets,payment_failures,subscription_plan,account_id\n"
        "42,18,2,1,0,business,7\n n/a,4,21,4,2,Starter ,8\n"
    )
    jobs.stage_score(spark, str(path), out, cfg)
    rows = {r["account_id"]: r for r in spark.read.option("header", True).csv(f"{out}/scored").collect()}
    assert rows["7"]["monthly_usage_hours"] == "42" and rows["8"]["subscription_plan"].strip() == "Starter"
    assert 0 <= float(rows["8"]["renewal_probability"]) <= 1 and "renewed" not in rows["7"].asDict()
    jobs.stage_explain(spark, str(path), out, cfg)
    assert spark.read.json(f"{out}/explained").count() == 2
    with pytest.raises(ValueError, match="renewed"):
        jobs.read_accounts(spark, str(path), cfg)


def test_half_written_tables_are_written_anew(spark, tmp_path):
    from retentia.sources.sinks import ensure_table

    path = str(tmp_path / "t")
    ensure_table(spark.range(10), path)
    os.remove(f"{path}/_SUCCESS")
    ensure_table(spark.range(20), path)
    assert spark.read.parquet(path).count() == 20
    ensure_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 20


def test_labels_are_whole_numbers(spark):
    rows = [("1.0",), ("0",), ("0.5",), ("1d",), (" 1 ",), (None,), ("1e400",)]
    df = spark.createDataFrame(rows, "renewed string")
    assert [r[0] for r in df.select(jobs.label_number(df, "renewed")).collect()] == [1, 0, None, None, 1, None, None]


def test_csv_accounts_without_id(spark, tmp_path):
    path = tmp_path / "accounts.csv"
    path.write_text(
        "monthly_usage_hours,login_frequency,last_login_days,support_tickets,payment_failures,subscription_plan,renewed\n"
        "42,18,2,1,0,business,1\n8,4,21,4,2,starter,0\nabc,1,1,1,1, Growth ,1\n"
    )
    df = jobs.read_accounts(spark, str(path), jobs.DEFAULT_CONFIG)
    assert df.count() == 3 and df.select("account_id").distinct().count() == 3
    from retentia.operators.features import account_features

    feats = {r["risk_score"] for r in account_features(df).collect()}
    assert 7.6659 in feats
