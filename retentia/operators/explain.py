"""Explanations: per-feature contributions, top drivers, global importance.

Contribution of feature i for one account = (value_i - training median_i)
* importance_i, with a missing median read as 0 and a missing importance as
1 (the original's fallback explainer, applied to whole tables).

The basis (medians + importances) is fitted once, like an MLlib model: the
medians are computed exactly and distributed, then collected (one number per
feature, a bounded collect) and used as literals. Contributions and top-k
drivers are then computed inside each row (array of structs, ``sort_array``,
``slice``, ``posexplode``): no join and no shuffle per account, and a top-k
never needs a window over an account's rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, MODEL_FEATURES, RenewalConfig
from .quantiles import collect_medians

# Importances of the oracle stand-in score (fixed, sum to 1). Not a model's.
STAND_IN_IMPORTANCES: tuple[float, ...] = (0.06, 0.09, 0.14, 0.07, 0.12, 0.05, 0.13, 0.04, 0.06, 0.08, 0.05, 0.11)


@dataclass(frozen=True)
class ExplanationBasis:
    features: tuple[str, ...]
    medians: tuple[tuple[str, float], ...]
    importances: tuple[float, ...]

    def baseline(self, feature: str) -> float:
        return float(dict(self.medians).get(feature, 0.0))

    def importance(self, index: int) -> float:
        return float(self.importances[index]) if index < len(self.importances) else 1.0


def fit_basis(
    training: DataFrame | None,
    importances: Sequence[float] | Mapping[str, float] | None = None,
    config: RenewalConfig = DEFAULT_CONFIG,
    medians: Mapping[str, float] | None = None,
) -> ExplanationBasis:
    """Exact training medians (unless given) + importances (default 1.0)."""
    features = tuple(config.model_features)
    if medians is None:
        medians = collect_medians(training, features)
    if importances is None:
        imp = tuple(1.0 for _ in features)
    elif isinstance(importances, Mapping):
        imp = tuple(float(importances.get(f, 1.0)) for f in features)
    else:
        imp = tuple(float(v) for v in importances)
    return ExplanationBasis(features, tuple((k, float(v)) for k, v in medians.items()), imp)


def contribution_exprs(basis: ExplanationBasis) -> list[Column]:
    out = []
    for i, f in enumerate(basis.features):
        out.append((F.col(f).cast(T.DoubleType()) - F.lit(basis.baseline(f))) * F.lit(basis.importance(i)))
    return out


def _entries(basis: ExplanationBasis) -> Column:
    exprs = contribution_exprs(basis)
    return F.array(
        *[
            F.struct(
                F.coalesce(-F.abs(c), F.lit(float("inf"))).alias("order"),
                F.lit(i).alias("feature_index"),
                F.lit(f).alias("feature"),
                F.col(f).cast(T.DoubleType()).alias("feature_value"),
                F.lit(basis.baseline(f)).alias("baseline"),
                F.lit(basis.importance(i)).alias("importance"),
                c.alias("contribution"),
            )
            for i, (f, c) in enumerate(zip(basis.features, exprs))
        ]
    )


def contributions(df: DataFrame, basis: ExplanationBasis, keep: Sequence[str] = ("account_id",)) -> DataFrame:
    """Long form: ``keep..., feature_index, feature, feature_value, baseline,
    importance, contribution``."""
    return df.select(*keep, F.inline(_entries(basis))).drop("order")


def top_factors(df: DataFrame, basis: ExplanationBasis, k: int, keep: Sequence[str] = ("account_id",)) -> DataFrame:
    """The ``k`` largest |contribution| per row, ties in feature order:
    ``keep..., rank, feature, feature_value, contribution``."""
    ranked = F.slice(F.sort_array(_entries(basis), asc=True), 1, int(k))
    return df.select(*keep, F.posexplode(ranked).alias("pos", "e")).select(
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("e.feature").alias("feature"),
        F.col("e.feature_value").alias("feature_value"),
        F.col("e.contribution").alias("contribution"),
    )


def top_factor_list(basis: ExplanationBasis, k: int) -> Column:
    """The ``k`` largest |contribution| of a row as an array of {feature,
    feature_value, shap_value}, ties in feature order."""
    ranked = F.slice(F.sort_array(_entries(basis), asc=True), 1, int(k))
    return F.transform(
        ranked,
        lambda e: F.struct(
            e["feature"].alias("feature"), e["feature_value"].alias("feature_value"), e["contribution"].alias("shap_value")
        ),
    )


def global_importance(df: DataFrame, basis: ExplanationBasis) -> DataFrame:
    """Mean |contribution| per feature over all rows, one aggregation pass:
    ``feature_index, feature, mean_abs_contribution``."""
    exprs = contribution_exprs(basis)
    wide = df.agg(*[F.avg(F.abs(c)).alias(f"_m{i}") for i, c in enumerate(exprs)])
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("feature_index"), F.lit(f).alias("feature"), F.col(f"_m{i}").alias("mean_abs_contribution"))
            for i, f in enumerate(basis.features)
        ]
    )
    return wide.select(F.inline(pairs))


def stand_in_basis(training: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> ExplanationBasis:
    """Basis of the oracle stand-in score: exact medians + fixed weights."""
    assert tuple(config.model_features) == MODEL_FEATURES or len(config.model_features) == len(STAND_IN_IMPORTANCES)
    return fit_basis(training, STAND_IN_IMPORTANCES, config)
