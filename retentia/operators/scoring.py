"""Batch scoring: probabilities, labels, risk segments, segment summary and
what-if scenarios.

All of it is narrow (row-wise) except the segment summary, which is a
three-group aggregation with partial aggregation. Predictions are appended
to the input rows as new columns (never by position), so each account keeps
its own prediction after any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BASE_NUMERIC_FEATURES, DEFAULT_CONFIG, DEFAULT_PLAN, PLAN_COLUMN, SCENARIOS, RenewalConfig
from ..functions.scoring import label_name, risk_segment, segment_insight, stand_in_probability, threshold_label

PROBABILITY = "renewal_probability"
PREDICTION = "renewal_prediction"
LABEL = "renewal_label"
SEGMENT = "risk_segment"
INSIGHT = "insight"


def score_stand_in(features: DataFrame) -> DataFrame:
    """Append the oracle stand-in probability (see ``functions.scoring``)."""
    return features.withColumn(PROBABILITY, stand_in_probability("risk_score"))


def add_predictions(scored: DataFrame, config: RenewalConfig = DEFAULT_CONFIG, probability: str = PROBABILITY) -> DataFrame:
    """Append ``renewal_prediction`` (``p >= threshold``) and ``renewal_label``."""
    label = threshold_label(F.col(probability), config.prediction_threshold)
    return scored.withColumn(PREDICTION, label).withColumn(LABEL, label_name(F.col(PREDICTION), config.label_names))


def add_segments(scored: DataFrame, probability: str = PROBABILITY) -> DataFrame:
    """Append ``risk_segment`` and its ``insight`` text."""
    return scored.withColumn(SEGMENT, risk_segment(F.col(probability))).withColumn(INSIGHT, segment_insight(F.col(SEGMENT)))


def segment_summary(segmented: DataFrame, target: str | None = None, probability: str = PROBABILITY) -> DataFrame:
    """Per segment: account count, mean probability and (if labelled) the
    observed renewal rate."""
    aggs = [F.count(F.lit(1)).alias("accounts"), F.avg(probability).alias("mean_probability")]
    if target and target in segmented.columns:
        aggs.append(F.avg(F.col(target).cast(T.DoubleType())).alias("renewal_rate"))
    return segmented.groupBy(SEGMENT).agg(*aggs)


def scenario_inputs(spark: SparkSession, reference: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """The what-if profiles as input rows: ``default`` (the reference data's
    median of each number, plan growth) and the fixed dashboard scenarios.

    The default row is an aggregate of the reference table (exact medians,
    one row), the fixed rows are literals; they are unioned, never joined.
    """
    from .quantiles import exact_medians

    med = exact_medians(reference, BASE_NUMERIC_FEATURES)
    default_row = med.agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in BASE_NUMERIC_FEATURES]
    ).select(
        F.lit("default").alias("profile"),
        *BASE_NUMERIC_FEATURES,
        F.lit(DEFAULT_PLAN).alias(PLAN_COLUMN),
    )
    schema = T.StructType(
        [T.StructField("profile", T.StringType(), False)]
        + [T.StructField(c, T.DoubleType(), True) for c in BASE_NUMERIC_FEATURES]
        + [T.StructField(PLAN_COLUMN, T.StringType(), True)]
    )
    fixed = spark.createDataFrame([(name, *values) for name, values in SCENARIOS], schema)
    return default_row.unionByName(fixed)


def apply_scenarios(accounts: DataFrame, scenarios: DataFrame, id_column: str = "account_id") -> DataFrame:
    """Accounts (profile ``account``) followed by the what-if profiles, as one
    table of input rows ready for feature building and scoring."""
    base = accounts.select(
        F.lit("account").alias("profile"),
        F.col(id_column),
        *[F.col(c).cast(T.DoubleType()).alias(c) for c in BASE_NUMERIC_FEATURES],
        F.col(PLAN_COLUMN),
    )
    extra = scenarios.select(
        "profile", F.lit(None).cast(base.schema[id_column].dataType).alias(id_column), *BASE_NUMERIC_FEATURES, PLAN_COLUMN
    )
    return base.unionByName(extra)

