"""Streaming scoring of account records.

Feature building, the stand-in probability, labels and segments are all
row-wise, so the batch functions apply unchanged to a ``readStream``
DataFrame; a fitted ``PipelineModel`` (see ``plans.training.score``) is
row-wise too. New account files in the input folder are scored as they
arrive; the checkpoint folder makes the query restartable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, RenewalConfig
from ..operators.features import account_features
from ..operators.scoring import add_predictions, add_segments, score_stand_in


def account_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def score_stream_stand_in(accounts: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """Features -> stand-in probability -> label -> segment, per row."""
    return add_segments(add_predictions(score_stand_in(account_features(accounts, config)), config))
