"""Scoring expressions: labels, risk segments and the oracle stand-in score."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    SEGMENT_CHURN,
    SEGMENT_HIGH_CUTOFF,
    SEGMENT_HIGH_RENEWAL,
    SEGMENT_INSIGHTS,
    SEGMENT_MODERATE,
    SEGMENT_MODERATE_CUTOFF,
)
from .columns import round_half_even

# Test stand-in for a trained model (a boosted tree cannot be written in SQL):
# a logistic curve of the rule-based risk score. It lets every downstream
# operator (labels, segments, metrics, explanations, drift) be checked against
# an independent SQL oracle. It is not the model.
STAND_IN_CENTER = 11.5
STAND_IN_SCALE = 6.0


def stand_in_probability(risk_score: str | Column = "risk_score") -> Column:
    r = F.col(risk_score) if isinstance(risk_score, str) else risk_score
    p = F.lit(1.0) / (F.lit(1.0) + F.exp((r - F.lit(STAND_IN_CENTER)) / F.lit(STAND_IN_SCALE)))
    return round_half_even(p, 6)


def threshold_label(probability: Column, threshold: float) -> Column:
    """1 when ``probability >= threshold`` else 0 (int)."""
    return F.when(probability >= F.lit(float(threshold)), F.lit(1)).otherwise(F.lit(0)).cast(T.IntegerType())


def label_name(label: Column, names: Mapping[int, str]) -> Column:
    """Label int -> name; a label missing from the map gives its own text."""
    out = label.cast(T.StringType())
    for key, value in names.items():
        out = F.when(label == F.lit(int(key)), F.lit(value)).otherwise(out)
    return out


def risk_segment(probability: Column) -> Column:
    """> 0.75 high renewal, >= 0.4 moderate, otherwise churn risk."""
    return (
        F.when(probability > F.lit(SEGMENT_HIGH_CUTOFF), F.lit(SEGMENT_HIGH_RENEWAL))
        .when(probability >= F.lit(SEGMENT_MODERATE_CUTOFF), F.lit(SEGMENT_MODERATE))
        .otherwise(F.lit(SEGMENT_CHURN))
    )


def segment_insight(segment: Column) -> Column:
    out = F.lit(None).cast(T.StringType())
    for name, text in SEGMENT_INSIGHTS:
        out = F.when(segment == F.lit(name), F.lit(text)).otherwise(out)
    return out
