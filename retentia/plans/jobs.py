"""The renewal pipeline as Spark jobs (what the original runs stage by stage).

    python -m retentia.plans.jobs validate  --accounts PATH --out DIR
    python -m retentia.plans.jobs features  --accounts PATH --out DIR
    python -m retentia.plans.jobs split     --out DIR
    python -m retentia.plans.jobs train     --out DIR [--n-trials N]
    python -m retentia.plans.jobs publish   --out DIR --serving DIR
    python -m retentia.plans.jobs drift     --out DIR
    python -m retentia.plans.jobs score     --accounts PATH --out DIR
    python -m retentia.plans.jobs explain   --accounts PATH --out DIR
    python -m retentia.plans.jobs all       --accounts PATH --out DIR --serving DIR

``--accounts`` is an account file or folder in ``--format`` (csv, the default,
or any format Spark reads), or with ``--format tables`` a test-data folder
(``sfX/``) from which the account table is derived. ``--config`` takes a
YAML or JSON parameter file (whole file or its feature section). All paths
may lie in any store Spark reads. Every stage reads and writes tables in
``--out``; features and splits are only materialized when missing. Scoring
and explaining need no target column.
"""

from __future__ import annotations

import argparse
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, RenewalConfig
from ..operators import drift as drift_ops
from ..operators import quality
from ..operators.features import account_features
from ..operators.scoring import PREDICTION, PROBABILITY, add_segments
from ..operators.split import stratified_split
from ..functions.columns import parse_numeric
from ..session import drop_stored, get_spark, stored
from ..sources.accounts import account_table
from ..sources.manifest import ensure_current
from ..sources.sinks import write_report, write_scored_csv, write_splits, write_table
from ..sources.tables import load_accounts
from . import training as T


def load_config(path: str | None, spark: SparkSession | None = None) -> RenewalConfig:
    if not path:
        return DEFAULT_CONFIG
    spark = spark or SparkSession.active()
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    return RenewalConfig.from_dict(raw)


def label_number(df: DataFrame, target: str) -> Column:
    """A label as an integer: numbers as they are written ("1", "1.0"); what
    is no whole number is null."""
    value = parse_numeric(target, df.schema[target].dataType)
    return F.when((value == F.floor(value)) & (F.abs(value) < 2**31), value).cast("int")


def read_accounts(
    spark: SparkSession, source: str, config: RenewalConfig, fmt: str = "csv", labelled: bool = True
) -> DataFrame:
    """Account rows with an id: derived from a test-data folder (``tables``),
    or read from files (CSV with header, all text, so coercion decides what
    parses). Rows without an id get a hash of their columns, which is stable
    under recomputation. Without ``labelled`` the target may be absent."""
    if fmt == "tables":
        return account_table(spark, source)
    required = list(config.source_columns if labelled else config.input_features)
    df = load_accounts(spark, source, required, fmt, optional=(config.id_column, config.target))
    if config.id_column not in df.columns:
        df = df.withColumn(config.id_column, F.xxhash64(*[F.col(c) for c in required]))
    if config.target in df.columns:
        df = df.withColumn(config.target, label_number(df, config.target))
    return df.select(config.id_column, *[c for c in df.columns if c != config.id_column])


def _paths(out: str) -> dict[str, str]:
    return {
        "validation": f"{out}/reports/validation",
        "features": f"{out}/features",
        "splits": f"{out}/splits",
        "model": f"{out}/model",
        "drift": f"{out}/reports/drift",
        "scored": f"{out}/scored",
        "explained": f"{out}/explained",
    }


def stage_validate(spark: SparkSession, accounts: str, out: str, config: RenewalConfig, fmt: str = "csv") -> dict[str, Any]:
    rows = read_accounts(spark, accounts, config, fmt)
    return quality.check_accounts(rows, config, _paths(out)["validation"], accounts)


#: Settings that a table depends on, and the tables that accounts come from.
FEATURE_SETTINGS = (
    "plan_scores", "inactivity_risk_weight", "payment_failure_risk_weight", "support_ticket_risk_weight",
    "engagement_relief_weight", "model_features", "input_features", "source_columns", "target", "id_column",
)
SPLIT_SETTINGS = ("target", "test_share", "random_state", "id_column")
ACCOUNT_TABLES = ("customer", "orders", "lineitem")


def _settings(config: RenewalConfig, names: tuple[str, ...]) -> dict[str, Any]:
    return {n: getattr(config, n) for n in names}


def stage_features(spark: SparkSession, accounts: str, out: str, config: RenewalConfig, fmt: str = "csv") -> bool:
    """The feature table, built unless it is that of these files and settings."""
    inputs = [f"{accounts}/{t}.parquet" for t in ACCOUNT_TABLES] if fmt == "tables" else [accounts]
    build = lambda: account_features(read_accounts(spark, accounts, config, fmt), config)
    return ensure_current(spark, _paths(out)["features"], build, inputs, _settings(config, FEATURE_SETTINGS) | {"format": fmt})


def stage_split(spark: SparkSession, out: str, config: RenewalConfig) -> bool:
    """The split, made again when the feature table or its settings change."""
    p = _paths(out)
    build = lambda: stratified_split(spark.read.parquet(p["features"]), config)
    return ensure_current(spark, p["splits"], build, [p["features"]], _settings(config, SPLIT_SETTINGS), write_splits)


def stage_train(spark: SparkSession, out: str, config: RenewalConfig, n_trials: int | None) -> dict[str, Any]:
    p = _paths(out)
    bundle = T.fit_and_evaluate(spark.read.parquet(p["splits"]), config, n_trials, bundle_path=p["model"])
    return bundle.metrics


def stage_publish(spark: SparkSession, out: str, serving: str) -> str:
    return T.publish_bundle(spark, _paths(out)["model"], serving)


def stage_drift(spark: SparkSession, out: str, config: RenewalConfig) -> None:
    p = _paths(out)
    bundle = T.load_bundle(spark, p["model"])
    splits = spark.read.parquet(p["splits"])
    # scored once; every report reads the stored table
    scored = stored(
        T.score(bundle, splits, config, (config.id_column, config.target, "split")), "scored", partition_by="split"
    )
    ref, cur = (scored.where(F.col("split") == side).drop("split") for side in ("train", "test"))
    cols = drift_ops.drift_columns(ref, cur, config.model_features, config.target, PROBABILITY)
    dist = stored(drift_ops.distribution_drift(ref, cur, cols, config), "drift")
    write_report(drift_ops.mean_delta(ref, cur, cols), f"{p['drift']}/mean_delta")
    write_report(dist, f"{p['drift']}/distribution")
    write_report(drift_ops.drift_summary(dist, ref, cur), f"{p['drift']}/summary")
    quality_report = drift_ops.quality_by_side(ref, cur, config.target, PROBABILITY, PREDICTION, config.positive_class)
    write_report(quality_report, f"{p['drift']}/quality")


def stage_score(spark: SparkSession, accounts: str, out: str, config: RenewalConfig, fmt: str = "csv") -> None:
    """The input rows with their predictions and segments; no target needed."""
    p = _paths(out)
    bundle = T.load_bundle(spark, p["model"])
    rows = read_accounts(spark, accounts, config, fmt, labelled=False)
    write_scored_csv(add_segments(T.score_accounts(bundle, rows, config)), p["scored"])


def stage_explain(spark: SparkSession, accounts: str, out: str, config: RenewalConfig, fmt: str = "csv") -> None:
    """An explanation record per account, from the fitted model."""
    p = _paths(out)
    bundle = T.load_bundle(spark, p["model"])
    rows = read_accounts(spark, accounts, config, fmt, labelled=False)
    write_table(T.explain_accounts(bundle, rows, config, (config.id_column,)), p["explained"], "json")


STAGES = ("validate", "features", "split", "train", "publish", "drift", "score", "explain")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="retentia.plans.jobs")
    ap.add_argument("stage", choices=[*STAGES, "all"])
    ap.add_argument("--accounts")
    ap.add_argument("--format", default="csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--serving")
    ap.add_argument("--config")
    ap.add_argument("--n-trials", type=int, default=None)
    args = ap.parse_args(argv)
    spark = get_spark("retentia-jobs")
    cfg = load_config(args.config, spark)
    accounts = (spark, args.accounts, args.out, cfg, args.format)
    run = {
        "validate": lambda: print(json.dumps(stage_validate(*accounts))),
        "features": lambda: stage_features(*accounts),
        "split": lambda: stage_split(spark, args.out, cfg),
        "train": lambda: print(json.dumps(stage_train(spark, args.out, cfg, args.n_trials), default=str)),
        "publish": lambda: print(stage_publish(spark, args.out, args.serving)),
        "drift": lambda: stage_drift(spark, args.out, cfg),
        "score": lambda: stage_score(*accounts),
        "explain": lambda: stage_explain(*accounts),
    }
    try:
        for stage in STAGES if args.stage == "all" else [args.stage]:
            run[stage]()
    finally:
        drop_stored(spark)


if __name__ == "__main__":
    main()
