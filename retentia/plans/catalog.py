"""Registered queries: one Spark plan per operator of the inventory.

Every query reads the whole test tables of a scale-factor folder (or what
Spark derives from them) and returns a lazy DataFrame, except where an
operator is fitted first (training medians for explanations: a bounded
collect of one number per feature, as a fitted model would hold).

Registered precision: the five derived ratio / log features and every
computed double whose last bits depend on summation order or on the math
library are rounded to 6 places (half to even on the scaled value) so that
the DuckDB oracle can be compared value by value. The library functions
themselves do not round.
"""

from __future__ import annotations

import uuid
import weakref
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BASE_NUMERIC_FEATURES, DEFAULT_CONFIG, MODEL_FEATURES, RATE_SLIDE, RATE_WINDOW
from ..functions.columns import q6
from ..operators import drift as drift_ops
from ..operators import drift_tests as test_ops
from ..operators import explain as explain_ops
from ..operators import metrics as metric_ops
from ..operators import profiles as profile_ops
from ..operators import quality
from ..operators import scoring as score_ops
from ..operators import sketches as sketch_ops
from ..operators.features import account_features, coerce_inputs, normalize_plans
from ..operators.quantiles import exact_medians, long_form
from ..operators.split import cv_folds, stratified_split
from ..sources.accounts import account_table
from ..streaming import requests as req
from ..sources.tables import load_accounts, load_accounts_apart, table
from ..session import ensure_checkpoint_dir, stored

CFG = DEFAULT_CONFIG
DERIVED_ROUNDED = ("engagement_score", "activity_ratio", "support_pressure", "payment_reliability", "usage_momentum")
DRIFT_COLUMNS = list(MODEL_FEATURES) + [score_ops.PROBABILITY, CFG.target]

Query = Callable[[SparkSession, str], DataFrame]


# -- registered building blocks --------------------------------------------------

# Lazy plans (not data) of the shared building blocks, per session and folder.
# Building the account / feature plan costs a few thousand driver-to-JVM
# calls; a registered query reuses the analysed plan the way it would read a
# view. Nothing is cached: every query still scans the tables. A scale-factor
# folder is treated as immutable for the life of a session.
_PLANS: "weakref.WeakKeyDictionary[SparkSession, dict[tuple[str, str], DataFrame]]" = weakref.WeakKeyDictionary()


def _plan(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    plans = _PLANS.setdefault(spark, {})
    key = (name, sf_dir)
    if key not in plans:
        plans[key] = build()
    return plans[key]


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "accounts", lambda: account_table(spark, sf_dir))


def registered_features(features: DataFrame) -> DataFrame:
    return features.withColumns({c: q6(c) for c in DERIVED_ROUNDED})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "features", lambda: registered_features(account_features(accounts(spark, sf_dir), CFG)))


def split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with its split: a stored table in the shared folder,
    partitioned by side (like the original's train / test files). Every later
    operator reads the side it needs instead of re-running the order-history
    scans, and a lost executor costs a re-read, not a recomputation."""
    return stratified_split(features(spark, sf_dir), CFG)


def scored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_ops.add_predictions(score_ops.score_stand_in(split_features(spark, sf_dir)), CFG)


def _test(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test")


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: q6(c) for c in cols})


# -- A / B: sources and features ---------------------------------------------------


def q_account_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir).select("account_id", *CFG.source_columns)


def q_coerced_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_inputs(accounts(spark, sf_dir)).select("account_id", *BASE_NUMERIC_FEATURES)


def q_plan_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = accounts(spark, sf_dir).select("account_id", F.col("subscription_plan").alias("raw_plan"), "subscription_plan")
    return normalize_plans(acc, CFG)


def q_plan_value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = normalize_plans(accounts(spark, sf_dir).select("account_id", "subscription_plan"), CFG)
    from ..functions.columns import lookup

    return acc.withColumn("plan_value_index", lookup("subscription_plan", CFG.plan_score_map))


def q_renewal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir)


def q_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("account_id", "engagement_score", "plan_value_index", "risk_score")


def q_top_risky_accounts(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Flagship report: the k riskiest accounts with their drivers (a top-k)."""
    scored = score_ops.add_segments(score_ops.score_stand_in(features(spark, sf_dir)))
    return scored.orderBy(F.desc("risk_score"), F.asc("account_id")).limit(k).select(
        "account_id", "renewed", "risk_score", "engagement_score", "payment_failures", "last_login_days",
        score_ops.PROBABILITY, score_ops.SEGMENT,
    )


# -- C: data quality -------------------------------------------------------------


def q_validation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validation_profile(accounts(spark, sf_dir), CFG)


def q_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_counts(accounts(spark, sf_dir), CFG.source_columns)


def q_target_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.target_classes(accounts(spark, sf_dir), CFG.target)


def q_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract_violations(accounts(spark, sf_dir))


# -- D: split, folds, medians, metrics --------------------------------------------


def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_features(spark, sf_dir).select("account_id", "renewed", "split")


def q_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(split_features(spark, sf_dir)).select("account_id", "renewed")
    return cv_folds(train, CFG)


def q_feature_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    med = exact_medians(_train(split_features(spark, sf_dir)), MODEL_FEATURES)
    return _round(med, "median")


def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_ops.confusion_matrix(_test(scored_split(spark, sf_dir)), CFG.target, score_ops.PREDICTION)


def q_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_ops.binary_metrics(_test(scored_split(spark, sf_dir)), CFG.target, score_ops.PREDICTION)


def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metric_ops.roc_auc(_test(scored_split(spark, sf_dir)), CFG.target, score_ops.PROBABILITY), "roc_auc")


def q_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = metric_ops.average_precision(_test(scored_split(spark, sf_dir)), CFG.target, score_ops.PROBABILITY)
    return _round(ap, "average_precision")


def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_ops.classification_report(_test(scored_split(spark, sf_dir)), CFG.target, score_ops.PREDICTION)


# -- E: scoring and explanation ----------------------------------------------------


def q_labeled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input rows with the predictions appended as columns. The raw inputs
    ride along as passthrough copies, so no join (and no shuffle) is needed
    to put predictions next to the rows they belong to."""
    acc = accounts(spark, sf_dir)
    raw = {f"_raw_{c}": F.col(c) for c in CFG.source_columns}
    feats = registered_features(account_features(acc.withColumns(raw), CFG))
    scored = score_ops.add_predictions(score_ops.score_stand_in(feats), CFG)
    return scored.select(
        "account_id",
        *[F.col(f"_raw_{c}").alias(c) for c in CFG.source_columns],
        score_ops.PROBABILITY,
        score_ops.PREDICTION,
        score_ops.LABEL,
    )


def q_risk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = score_ops.add_segments(score_ops.score_stand_in(features(spark, sf_dir)))
    return seg.select("account_id", score_ops.PROBABILITY, score_ops.SEGMENT, score_ops.INSIGHT)


def q_segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = score_ops.add_segments(score_ops.score_stand_in(features(spark, sf_dir)))
    return _round(score_ops.segment_summary(seg, CFG.target), "mean_probability", "renewal_rate")


def _basis_and_table(spark: SparkSession, sf_dir: str) -> tuple[explain_ops.ExplanationBasis, DataFrame]:
    split = split_features(spark, sf_dir)
    basis = explain_ops.stand_in_basis(_train(split), CFG)
    return basis, split


def q_feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis, table_ = _basis_and_table(spark, sf_dir)
    out = explain_ops.contributions(table_, basis).select("account_id", "feature_index", "feature", "feature_value", "contribution")
    return _round(out, "contribution")


def q_top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis, table_ = _basis_and_table(spark, sf_dir)
    return _round(explain_ops.top_factors(table_, basis, CFG.top_k), "contribution")


def q_global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis, table_ = _basis_and_table(spark, sf_dir)
    return _round(explain_ops.global_importance(table_, basis), "mean_abs_contribution")


def q_scenario_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What-if profiles scored together with the whole account base.

    The accounts' features are the stored feature table; only the profile
    rows are built here, so the order history is derived once."""
    split = split_features(spark, sf_dir)
    scenarios = score_ops.scenario_inputs(spark, _train(split), CFG)
    profiles = scenarios.select("profile", F.lit(None).cast(T.LongType()).alias("account_id"), *BASE_NUMERIC_FEATURES, "subscription_plan")
    profile_feats = registered_features(account_features(profiles, CFG))
    account_feats = split.select(F.lit("account").alias("profile"), "account_id", *MODEL_FEATURES)
    scored = score_ops.score_stand_in(account_feats.unionByName(profile_feats))
    # one non-null text key for accounts and profiles alike
    subject = F.coalesce(F.col("account_id").cast(T.StringType()), F.col("profile")).alias("subject")
    out = score_ops.add_segments(scored).drop(score_ops.INSIGHT)
    return out.select(subject, *[c for c in out.columns if c != "account_id"])


# -- F: drift ------------------------------------------------------------------------


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = scored_split(spark, sf_dir)
    return _train(scored), _test(scored)


def q_drift_mean_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    out = drift_ops.mean_delta(ref, cur, DRIFT_COLUMNS)
    return _round(out, "reference_mean", "current_mean", "mean_delta")


def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    return drift_ops.distribution_drift(ref, cur, DRIFT_COLUMNS, CFG)


def q_drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_distribution(spark, sf_dir).select("column", "psi"), "psi")


def q_drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_distribution(spark, sf_dir).select("column", "ks_statistic"), "ks_statistic")


def q_drift_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_distribution(spark, sf_dir).select("column", "wasserstein"), "wasserstein")


def q_drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    dist = drift_ops.distribution_drift(ref, cur, DRIFT_COLUMNS, CFG)
    return drift_ops.drift_summary(dist, ref, cur)


def q_quality_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    out = drift_ops.quality_by_side(ref, cur, CFG.target, score_ops.PROBABILITY, score_ops.PREDICTION)
    return _round(out, "roc_auc", "average_precision")


# -- G: request monitoring (batch twins of the streaming queries) ------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.request_log(table(spark, sf_dir, "events"))


def q_request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.request_totals(_log(spark, sf_dir))


def q_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(req.latency_histogram(_log(spark, sf_dir)), "latency_sum")


def q_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.error_rate(_log(spark, sf_dir))


def q_request_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.request_rate(_log(spark, sf_dir), "5 minutes")


def q_request_rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's rate: 5 minutes, every 15 seconds."""
    return req.request_rate(_log(spark, sf_dir), RATE_WINDOW, RATE_SLIDE)


def q_drift_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between accounts of the smaller plans and those of the larger
    ones, two sides that do differ."""
    scored = stored(score_ops.score_stand_in(features(spark, sf_dir)), "scored")
    small = F.col("plan_value_index") < F.lit(CFG.plan_score_map["business"])
    out = drift_ops.distribution_drift(scored.where(small), scored.where(~small), DRIFT_COLUMNS, CFG)
    return _round(out, "psi", "ks_statistic", "wasserstein")


def q_drift_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two sides, every column by the test of its kind: the plan and
    the label are categories."""
    plans = accounts(spark, sf_dir).withColumn("plan", F.col("subscription_plan"))
    with_plan = normalize_plans(account_features(plans, CFG), CFG, "plan")
    scored = stored(score_ops.score_stand_in(registered_features(with_plan)), "scored")
    small = F.col("plan_value_index") < F.lit(CFG.plan_score_map["business"])
    columns = [*DRIFT_COLUMNS, "plan"]
    out = test_ops.drift_tests(scored.where(small), scored.where(~small), columns, categories=[CFG.target])
    return _round(out, "statistic", "distance", "p_value")


# -- sketches per load -----------------------------------------------------------


LOADS = 3


def _sketched_loads(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The sketches of ``rows``, which arrive in loads by account id."""
    path = _scratch(spark, "sketches")
    for i in range(LOADS):
        sketch_ops.add_load(rows.where(F.col("account_id") % LOADS == i), MODEL_FEATURES, path, str(i))
    return sketch_ops.merged(sketch_ops.read_loads(spark, path))


def q_sketched_medians_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say about medians merged from the sketches of three loads:
    the values seen, and the columns whose median has a rank further from the
    middle than the sketches' bound."""
    rows = stored(features(spark, sf_dir), "feature_rows")
    sketches = stored(_sketched_loads(spark, rows), "merged_sketches")
    medians = sketch_ops.sketched_medians(sketches)
    values = long_form(rows, MODEL_FEATURES).where(F.col("value").isNotNull() & ~F.isnan("value"))
    ranks = values.join(F.broadcast(medians), "column").groupBy("column").agg(  # a row per column
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"),
        F.avg((F.col("value") <= F.col("median")).cast("double")).alias("up_to"),
    )
    bound = sketch_ops.RANK_ERROR
    outside = (F.col("below") > 0.5 + bound) | (F.col("up_to") < 0.5 - bound)
    return ranks.join(sketches.select("column", F.col("n").alias("seen")), "column").agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum("seen").alias("sketched_values"),
        F.count_if(F.col("seen") != F.col("n")).alias("miscounted"),
        F.count_if(outside).alias("violations"),
    )


def q_sketched_psi_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say about the decile shares of sketches, small against
    large plans: the buckets whose share is further from the counted one than
    two ranks' bounds."""
    rows = stored(features(spark, sf_dir), "feature_rows")
    small = F.col("plan_value_index") < F.lit(CFG.plan_score_map["business"])
    sides = {"ref": rows.where(small), "cur": rows.where(~small)}
    psi = stored(sketch_ops.sketched_psi(*(_sketched_loads(spark, x) for x in sides.values())), "sketched_psi")
    bound, checked = 2 * sketch_ops.RANK_ERROR, []
    for side, part in sides.items():
        values = long_form(part, MODEL_FEATURES).where(F.col("value").isNotNull() & ~F.isnan("value"))
        cuts = F.transform("buckets", lambda b: b["cut"])
        placed = values.join(F.broadcast(psi), "column").withColumn(  # a row per column
            "at", F.size(F.filter(cuts, lambda c: c < F.col("value")))
        )
        counted = placed.groupBy("column", "at").agg(F.count(F.lit(1)).alias("n"))
        shares = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))
        told = psi.select("column", F.posexplode("buckets").alias("at", "b"))
        both = told.join(shares, ["column", "at"], "left")
        gap = F.abs(F.coalesce("share", F.lit(0.0)) - F.col(f"b.p_{side}"))
        checked.append(both.agg(F.count_distinct("column").alias("columns"), F.count_if(gap > bound).alias("violations")))
    out = checked[0].unionByName(checked[1])
    return out.agg(F.max("columns").alias("columns"), F.sum("violations").alias("violations"))


# -- untidy account files ------------------------------------------------------------


def text_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts as an untidy export: all text, with junk numbers, blanks,
    unknown and missing plans and float labels, by account id."""
    acc = accounts(spark, sf_dir)
    k = F.col("account_id")
    whole = lambda c: F.floor(F.col(c)).cast("bigint").cast("string")
    null = F.lit(None).cast("string")
    hours = F.coalesce(whole("monthly_usage_hours"), F.lit("0"))
    for i, v in enumerate(("n/a", "1d", " 12.5 ", None, "-3", "1e2")):
        hours = F.when(k % 7 == i, null if v is None else F.lit(v)).otherwise(hours)
    plan = F.col("subscription_plan")
    for i, v in enumerate((None, "", "\tGROWTH ", "x")):
        plan = F.when(k % 5 == i, null if v is None else F.lit(v)).otherwise(plan)
    label = F.col("renewed").cast("string")
    for i, v in enumerate((F.lit("1.0"), F.lit("0"), F.lit("1d"), null, F.concat(label, F.lit(".0")))):
        label = F.when(k % 6 == i, v).otherwise(label)
    numbers = {c: whole(c) for c in BASE_NUMERIC_FEATURES} | {"monthly_usage_hours": hours}
    return acc.select(
        k.cast("string").alias("account_id"),
        *[numbers[c].alias(c) for c in BASE_NUMERIC_FEATURES],
        plan.alias("subscription_plan"),
        label.alias("renewed"),
    )


def csv_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_accounts`` written as CSV and read back as an account file."""
    path = _scratch(spark, "csv")
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    text_accounts(spark, sf_dir).write.options(**options).csv(path)
    return load_accounts(spark, path, CFG.source_columns, "csv", optional=("account_id",))


def q_untidy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, contract codes and label of untidy account rows."""
    from .jobs import label_number

    rows = csv_accounts(spark, sf_dir)
    rows = rows.withColumn("label", label_number(rows, "renewed")).withColumn(
        "violations", F.concat_ws(",", *quality.contract_checks(rows))
    )
    feats = account_features(rows.withColumn("account_id", F.col("account_id").cast("bigint")), CFG)
    return registered_features(feats).drop("renewed")


def q_untidy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validation_profile(csv_accounts(spark, sf_dir), CFG)


def q_untidy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.target_classes(csv_accounts(spark, sf_dir), CFG.target)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder among this application's stored tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def q_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account file with planted broken lines, read apart: the ids of its
    good rows and the broken lines themselves."""
    path, k = _scratch(spark, "broken"), F.col("account_id")
    fields = [F.floor(F.col(c)).cast("bigint").cast("string") for c in BASE_NUMERIC_FEATURES]
    whole = F.concat_ws(",", k.cast("string"), *[F.coalesce(f, F.lit("0")) for f in fields])
    line = F.when(k % 11 == 0, F.concat(k.cast("string"), F.lit(",1"))).when(k % 13 == 0, F.concat(whole, F.lit(",extra"))).otherwise(whole)
    header = ",".join(["account_id", *BASE_NUMERIC_FEATURES])
    # one field a line, as it is: its name is the header
    plain = {"header": True, "sep": "\u0001", "quote": "\u0000", "escapeQuotes": False}
    accounts(spark, sf_dir).select(line.alias(header)).write.options(**plain).csv(path)
    good, broken = load_accounts_apart(spark, path, ["account_id", *BASE_NUMERIC_FEATURES])
    return good.select("account_id", F.lit(None).cast("string").alias("line")).unionByName(
        broken.select(F.col("first_field").alias("account_id"), "line")
    )


def q_incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of an account file that arrives in three loads, each read
    once; ``read``: the files that the three updates read."""
    folder, store = _scratch(spark, "loads"), _scratch(spark, "profiles")
    rows = stored(text_accounts(spark, sf_dir), "text_accounts")
    columns, read = list(CFG.source_columns), 0
    for i in range(LOADS):
        rows.where(F.col("account_id").cast("bigint") % LOADS == i).coalesce(1).write.parquet(f"{folder}/{i}")
        read += profile_ops.update_profiles(spark, folder, store, columns, CFG.target)
    out = profile_ops.table_profile(profile_ops.current_profiles(spark, folder, store), columns)
    counted = spark.range(1).select(F.lit("read").alias("measure"), F.lit("").alias("name"), F.lit(read).cast("bigint").alias("value"))
    return out.unionByName(counted)


QUERIES: dict[str, Query] = {
    "account_scan": q_account_scan,
    "coerced_inputs": q_coerced_inputs,
    "plan_normalized": q_plan_normalized,
    "plan_value_index": q_plan_value_index,
    "renewal_features": q_renewal_features,
    "risk_score": q_risk_score,
    "top_risky_accounts": q_top_risky_accounts,
    "validation_profile": q_validation_profile,
    "null_counts": q_null_counts,
    "target_classes": q_target_classes,
    "contract_violations": q_contract_violations,
    "stratified_split": q_stratified_split,
    "cv_folds": q_cv_folds,
    "feature_medians": q_feature_medians,
    "confusion_matrix": q_confusion_matrix,
    "binary_metrics": q_binary_metrics,
    "roc_auc": q_roc_auc,
    "average_precision": q_average_precision,
    "classification_report": q_classification_report,
    "labeled_predictions": q_labeled_predictions,
    "risk_segments": q_risk_segments,
    "segment_summary": q_segment_summary,
    "feature_contributions": q_feature_contributions,
    "top_factors": q_top_factors,
    "global_importance": q_global_importance,
    "scenario_features": q_scenario_features,
    "drift_mean_delta": q_drift_mean_delta,
    "drift_psi": q_drift_psi,
    "drift_ks": q_drift_ks,
    "drift_wasserstein": q_drift_wasserstein,
    "drift_summary": q_drift_summary,
    "quality_by_side": q_quality_by_side,
    "request_totals": q_request_totals,
    "latency_histogram": q_latency_histogram,
    "error_rate": q_error_rate,
    "request_rate_5m": q_request_rate_5m,
    "request_rate_sliding": q_request_rate_sliding,
    "drift_shifted": q_drift_shifted,
    "drift_tests": q_drift_tests,
    "sketched_medians_check": q_sketched_medians_check,
    "sketched_psi_check": q_sketched_psi_check,
    "untidy_features": q_untidy_features,
    "untidy_profile": q_untidy_profile,
    "untidy_classes": q_untidy_classes,
    "broken_lines": q_broken_lines,
    "incremental_profile": q_incremental_profile,
}


def oracles() -> dict[str, str]:
    from . import oracle_sql as o

    return {name: getattr(o, name)() for name in [*QUERIES, *o.MODEL_CHECKS]}
