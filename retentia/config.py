"""Run configuration for every renewal operator.

One frozen dataclass is passed to each operator instead of a nested dict, so
a job on a cluster ships the same settings to every stage. ``RenewalConfig.
from_dict`` accepts either a whole parameter file (as a dict) or only its
feature-engineering section, and falls back to the defaults below for
anything missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any, Mapping

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original project's parameters for the
# results to agree; they are stated here plainly, in their natural order.
# ---------------------------------------------------------------------------

BASE_NUMERIC_FEATURES: tuple[str, ...] = (
    "monthly_usage_hours",
    "login_frequency",
    "last_login_days",
    "support_tickets",
    "payment_failures",
)
PLAN_COLUMN = "subscription_plan"
TARGET_COLUMN = "renewed"
INPUT_FEATURES: tuple[str, ...] = BASE_NUMERIC_FEATURES + (PLAN_COLUMN,)
SOURCE_COLUMNS: tuple[str, ...] = INPUT_FEATURES + (TARGET_COLUMN,)

MODEL_FEATURES: tuple[str, ...] = (
    "monthly_usage_hours",
    "login_frequency",
    "last_login_days",
    "support_tickets",
    "payment_failures",
    "plan_value_index",
    "engagement_score",
    "activity_ratio",
    "support_pressure",
    "payment_reliability",
    "usage_momentum",
    "risk_score",
)

DEFAULT_PLAN = "growth"
PLAN_SCORES: tuple[tuple[str, float], ...] = (
    ("starter", 0.7),
    ("growth", 1.0),
    ("business", 1.3),
    ("enterprise", 1.6),
)
INACTIVITY_RISK_WEIGHT = 0.12
PAYMENT_FAILURE_RISK_WEIGHT = 1.75
SUPPORT_TICKET_RISK_WEIGHT = 0.55
ENGAGEMENT_RELIEF_WEIGHT = 0.85
PLAN_RELIEF_WEIGHT = 0.35  # not configurable in the original either
RISK_SCORE_DECIMALS = 4

POSITIVE_CLASS = 1
LABEL_MAP: tuple[tuple[int, str], ...] = ((0, "not_renewed"), (1, "renewed"))
TEST_SHARE = 0.2
RANDOM_STATE = 111
CV_FOLDS = 3
N_TRIALS = 25
CV_METRIC = "roc_auc"
PREDICTION_THRESHOLD = 0.5
EVALUATION_THRESHOLD = 0.5
TOP_K = 5
DASHBOARD_TOP_K = 3

# Request contract: numbers must be >= 0, plan text 3..32 characters.
PLAN_MIN_LENGTH = 3
PLAN_MAX_LENGTH = 32

# Gradient-boosting search space (first value of each range = default run).
GBT_RANGES: tuple[tuple[str, tuple[Any, ...]], ...] = (
    ("n_estimators", (80, 220)),
    ("learning_rate", (0.03, 0.25)),
    ("max_depth", (2, 5)),
    ("min_samples_split", (2, 18)),
    ("min_samples_leaf", (1, 8)),
    ("subsample", (0.7, 1.0)),
    ("max_features", ("sqrt", "log2", None)),
)

# Risk segments of the scoring dashboard: > 0.75, >= 0.4, otherwise.
SEGMENT_HIGH_RENEWAL = "High Renewal Probability"
SEGMENT_MODERATE = "Moderate Risk"
SEGMENT_CHURN = "High Churn Risk"
SEGMENT_HIGH_CUTOFF = 0.75
SEGMENT_MODERATE_CUTOFF = 0.4
SEGMENT_INSIGHTS: tuple[tuple[str, str], ...] = (
    (SEGMENT_HIGH_RENEWAL, "User is highly engaged and likely to renew."),
    (SEGMENT_MODERATE, "User shows moderate engagement. Consider targeted engagement strategies."),
    (SEGMENT_CHURN, "User is at high risk of non-renewal. Immediate retention action recommended."),
)

# What-if profiles of the scoring dashboard.
SCENARIOS: tuple[tuple[str, tuple[float, float, float, float, float, str]], ...] = (
    ("high_risk", (8.0, 4.0, 21.0, 4.0, 2.0, "starter")),
    ("high_engagement", (58.0, 24.0, 1.0, 0.0, 0.0, "business")),
)

# Request-latency histogram bucket upper bounds, in seconds (+Inf implied).
LATENCY_BUCKETS: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
RATE_WINDOW = "5 minutes"
RATE_SLIDE = "15 seconds"  # the metrics scrape interval

# ---------------------------------------------------------------------------
# Our own choices (not in the original project).
# ---------------------------------------------------------------------------

# Drift thresholds: the original delegates to a third-party preset whose
# thresholds are not in the project; these are the conventional values.
PSI_BUCKETS = 10
PSI_THRESHOLD = 0.2
KS_THRESHOLD = 0.1
PSI_FLOOR = 1e-4
DATASET_DRIFT_SHARE = 0.5
STREAM_WATERMARK = "10 minutes"


@dataclass(frozen=True)
class RenewalConfig:
    """All settings of the renewal jobs; immutable and cheap to pickle."""

    plan_scores: tuple[tuple[str, float], ...] = PLAN_SCORES
    inactivity_risk_weight: float = INACTIVITY_RISK_WEIGHT
    payment_failure_risk_weight: float = PAYMENT_FAILURE_RISK_WEIGHT
    support_ticket_risk_weight: float = SUPPORT_TICKET_RISK_WEIGHT
    engagement_relief_weight: float = ENGAGEMENT_RELIEF_WEIGHT
    model_features: tuple[str, ...] = MODEL_FEATURES
    input_features: tuple[str, ...] = INPUT_FEATURES
    source_columns: tuple[str, ...] = SOURCE_COLUMNS
    target: str = TARGET_COLUMN
    positive_class: int = POSITIVE_CLASS
    label_map: tuple[tuple[int, str], ...] = LABEL_MAP
    test_share: float = TEST_SHARE
    random_state: int = RANDOM_STATE
    cv_folds: int = CV_FOLDS
    n_trials: int = N_TRIALS
    cv_metric: str = CV_METRIC
    prediction_threshold: float = PREDICTION_THRESHOLD
    top_k: int = TOP_K
    gbt_ranges: tuple[tuple[str, tuple[Any, ...]], ...] = GBT_RANGES
    psi_buckets: int = PSI_BUCKETS
    psi_threshold: float = PSI_THRESHOLD
    ks_threshold: float = KS_THRESHOLD
    id_column: str = "account_id"
    extra: Mapping[str, Any] = field(default_factory=dict, compare=False, hash=False)

    @property
    def plan_score_map(self) -> dict[str, float]:
        return dict(self.plan_scores)

    @property
    def label_names(self) -> dict[int, str]:
        return dict(self.label_map)

    @property
    def gbt_space(self) -> dict[str, tuple[Any, ...]]:
        return dict(self.gbt_ranges)

    def with_(self, **changes: Any) -> "RenewalConfig":
        return replace(self, **changes)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any] | None) -> "RenewalConfig":
        """Build from a parameter dict: the whole file or its feature section."""
        if not raw:
            return cls()
        feature = raw.get("feature_engineering", raw)
        raw_data = raw.get("raw_data_config", {})
        training = raw.get("training", {})
        changes: dict[str, Any] = {}
        if "plan_scores" in feature:
            changes["plan_scores"] = tuple((str(k), float(v)) for k, v in feature["plan_scores"].items())
        for name in (
            "inactivity_risk_weight",
            "payment_failure_risk_weight",
            "support_ticket_risk_weight",
            "engagement_relief_weight",
        ):
            if name in feature:
                changes[name] = float(feature[name])
        if "model_features" in feature:
            changes["model_features"] = tuple(feature["model_features"])
        if "input_features" in raw_data:
            changes["input_features"] = tuple(raw_data["input_features"])
        if "source_columns" in raw_data:
            changes["source_columns"] = tuple(raw_data["source_columns"])
        if "target" in raw_data:
            changes["target"] = str(raw_data["target"])
        if "positive_class" in raw_data:
            changes["positive_class"] = int(raw_data["positive_class"])
        if "train_test_split_ratio" in raw_data:
            changes["test_share"] = float(raw_data["train_test_split_ratio"])
        if "random_state" in raw_data:
            changes["random_state"] = int(raw_data["random_state"])
        for src, dst in (("cv_folds", "cv_folds"), ("n_trials", "n_trials")):
            if src in training:
                changes[dst] = int(training[src])
        if "scoring" in training:
            changes["cv_metric"] = str(training["scoring"])
        if "prediction_threshold" in training:
            changes["prediction_threshold"] = float(training["prediction_threshold"])
        if "gradient_boosting" in raw:
            changes["gbt_ranges"] = tuple(
                (k, tuple(None if v in ("null", None) else v for v in vals))
                for k, vals in raw["gradient_boosting"].items()
            )
        shap = raw.get("shap", {})
        if "top_k" in shap:
            changes["top_k"] = int(shap["top_k"])
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in changes.items() if k in known})


DEFAULT_CONFIG = RenewalConfig()
