"""Feature engineering: coercion, plan normalization and the model features.

``account_features`` is one narrow projection: no shuffle, no Python,
all inside whole-stage code generation. Passthrough columns (ids, the label,
anything else the input carries) come first, then the model features in the
configured order; the raw plan text is dropped, as in the original.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BASE_NUMERIC_FEATURES, DEFAULT_CONFIG, DEFAULT_PLAN, PLAN_COLUMN, PLAN_RELIEF_WEIGHT, RISK_SCORE_DECIMALS, RenewalConfig
from ..functions.columns import clip_lower, coerce_numeric, lookup, normalize_plan, ratio, round_half_even
from ..sources.tables import require_columns


def coerce_inputs(df: DataFrame, columns: Sequence[str] = BASE_NUMERIC_FEATURES) -> DataFrame:
    """Numeric coercion in place: unparsable / null / NaN -> 0.0, type double."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: coerce_numeric(c, types[c]) for c in columns})


def normalize_plans(df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG, column: str = PLAN_COLUMN) -> DataFrame:
    """Plan text -> one of the four known plans (default ``growth``)."""
    allowed = ("starter", "growth", "business", "enterprise")
    return df.withColumn(column, normalize_plan(column, allowed, DEFAULT_PLAN))


def feature_columns(config: RenewalConfig = DEFAULT_CONFIG) -> dict[str, F.Column]:
    """The seven derived features as expressions over coerced inputs."""
    hours = F.col("monthly_usage_hours")
    logins = F.col("login_frequency")
    days = F.col("last_login_days")
    tickets = F.col("support_tickets")
    failures = F.col("payment_failures")
    one = F.lit(1.0)

    plan_value = lookup(PLAN_COLUMN, config.plan_score_map).cast(T.DoubleType())
    engagement = ratio(hours, days + one)
    raw_risk = (
        failures * F.lit(config.payment_failure_risk_weight)
        + days * F.lit(config.inactivity_risk_weight)
        + tickets * F.lit(config.support_ticket_risk_weight)
        - F.col("engagement_score") * F.lit(config.engagement_relief_weight)
        - F.col("plan_value_index") * F.lit(PLAN_RELIEF_WEIGHT)
    )
    return {
        "plan_value_index": plan_value,
        "engagement_score": engagement,
        "activity_ratio": ratio(logins, hours + one),
        "support_pressure": ratio(tickets, logins + one),
        "payment_reliability": ratio(one, failures + one),
        "usage_momentum": hours * F.log1p(logins),
        "risk_score": round_half_even(clip_lower(raw_risk, 0.0), RISK_SCORE_DECIMALS),
    }


def account_features(df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """Raw account rows -> passthrough columns + the model features."""
    require_columns(df, config.input_features, "subscription input")
    frame = normalize_plans(coerce_inputs(df), config)
    exprs = feature_columns(config)
    # risk_score reads engagement_score and plan_value_index: add in two steps
    first = {k: v for k, v in exprs.items() if k != "risk_score"}
    frame = frame.withColumns(first).withColumn("risk_score", exprs["risk_score"])
    model = list(config.model_features)
    passthrough = [c for c in frame.columns if c not in model and c != PLAN_COLUMN]
    return frame.select(*passthrough, *model)


def model_frame(df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG, keep: Sequence[str] = ()) -> DataFrame:
    """The model's feature frame, with ``keep`` columns in front.

    If every model feature is already present the input is used as it is (a
    projection and a cast); otherwise the raw inputs are required and the
    features are built.
    """
    features = list(config.model_features)
    if set(features).issubset(df.columns):
        return df.select(*keep, *[F.col(c).cast(T.DoubleType()).alias(c) for c in features])
    require_columns(df, config.input_features, "subscription input")
    built = account_features(df.select(*keep, *config.input_features), config)
    return built.select(*keep, *[F.col(c).cast(T.DoubleType()).alias(c) for c in features])
