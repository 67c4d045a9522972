"""Data-quality checks: row count, missing columns, nulls, target classes,
and the per-row request contract.

Every check is a single aggregation pass (partial aggregation on each
partition, one tiny final merge); per-column results are turned into long
form with ``explode`` of a literal array, never one job per column.
"""

from __future__ import annotations

import json
from typing import Any, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BASE_NUMERIC_FEATURES, DEFAULT_CONFIG, PLAN_COLUMN, PLAN_MAX_LENGTH, PLAN_MIN_LENGTH, RenewalConfig
from ..functions.columns import parse_numeric

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def unexpected_columns(df: DataFrame, allowed: Sequence[str]) -> list[str]:
    """Columns outside the contract (the request schema forbids extras)."""
    return [c for c in df.columns if c not in allowed]


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, null_count)`` from one aggregation pass."""
    present = [c for c in columns if c in df.columns]
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in present])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in present])
    return wide.select(F.inline(pairs))


def _target(df: DataFrame, target: str) -> F.Column:
    """The target as a number, null where it is none (the same grammar as for
    numeric inputs); typed targets keep their type."""
    kind = df.schema[target].dataType
    return F.col(target) if isinstance(kind, _NUMERIC) else parse_numeric(target, kind)


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Distinct numeric target values, sorted; text that does not parse is dropped."""
    return (
        df.select(_target(df, target).alias("target_class"))
        .where(F.col("target_class").isNotNull() & ~F.isnan(F.col("target_class").cast(T.DoubleType())))
        .distinct()
        .orderBy("target_class")
    )


def validation_profile(df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """One row: row count, null cells, columns with nulls, class summary.

    All of it comes from one pass over the data.
    """
    cols = [c for c in config.source_columns if c in df.columns]
    target = _target(df, config.target).cast(T.DoubleType())
    target = F.nanvl(target, F.lit(None).cast(T.DoubleType()))
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_n_{c}") for c in cols]
    aggs += [
        F.count_distinct(target).alias("target_class_count"),
        F.min(target).alias("_tmin"),
        F.max(target).alias("_tmax"),
    ]
    wide = df.agg(*aggs)
    null_cells = sum((F.col(f"_n_{c}") for c in cols), F.lit(0).cast(T.LongType()))
    null_cols = sum((F.when(F.col(f"_n_{c}") > 0, 1).otherwise(0) for c in cols), F.lit(0))
    return wide.select(
        "row_count",
        F.lit(len(missing_columns(df, config.source_columns))).alias("missing_column_count"),
        null_cells.cast(T.LongType()).alias("null_cells"),
        null_cols.cast(T.IntegerType()).alias("columns_with_nulls"),
        "target_class_count",
        ((F.col("target_class_count") == 2) & (F.col("_tmin") == 0) & (F.col("_tmax") == 1)).alias("binary_target"),
    )


def contract_checks(df: DataFrame) -> list[F.Column]:
    """One nullable code per rule: numbers present (text that is no number
    counts as missing) and >= 0, plan 3..32 chars."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    checks: list[F.Column] = []
    for c in BASE_NUMERIC_FEATURES:
        v = parse_numeric(c, kinds[c])
        checks.append(F.when(v.isNull(), F.lit(f"{c}:missing")))
        checks.append(F.when(v < 0, F.lit(f"{c}:negative")))
    plan_len = F.char_length(F.col(PLAN_COLUMN))
    checks.append(F.when(F.col(PLAN_COLUMN).isNull(), F.lit(f"{PLAN_COLUMN}:missing")))
    checks.append(F.when((plan_len < PLAN_MIN_LENGTH) | (plan_len > PLAN_MAX_LENGTH), F.lit(f"{PLAN_COLUMN}:length")))
    return checks


def contract_violations(df: DataFrame, id_column: str = "account_id") -> DataFrame:
    """Per-row contract of the scoring request (re-aimed from request
    validation to whole tables): id, comma-joined codes, count, validity."""
    checks = contract_checks(df)
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in checks), F.lit(0))
    return df.select(
        F.col(id_column),
        F.concat_ws(",", *checks).alias("violations"),
        count.cast(T.IntegerType()).alias("violation_count"),
        (count == 0).alias("is_valid"),
    )


def split_by_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows + their codes); narrow filters, no join."""
    tagged = df.withColumn("violations", F.concat_ws(",", *contract_checks(df)))
    good = tagged.where(F.col("violations") == "").drop("violations")
    bad = tagged.where(F.col("violations") != "")
    return good, bad


def check_accounts(
    df: DataFrame,
    config: RenewalConfig = DEFAULT_CONFIG,
    report_path: str | None = None,
    data_path: str = "",
) -> dict[str, Any]:
    """Validation report (written first, by the executors), then errors.

    ``report_path`` gets two tables: ``summary`` (one JSON row: counts, nulls,
    target class count and range) and ``target_classes`` (one row per class,
    however many there are).
    """
    spark = df.sparkSession
    missing = missing_columns(df, config.source_columns)
    present = [c for c in config.source_columns if c in df.columns]
    labelled = config.target in df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in present]
    if labelled:
        y = F.nanvl(_target(df, config.target).cast(T.DoubleType()), F.lit(None).cast(T.DoubleType()))
        aggs += [F.count_distinct(y).alias("_classes"), F.min(y).alias("_least"), F.max(y).alias("_largest")]
    row = df.agg(*aggs).first()
    nulls = {c: int(row[c]) for c in present}
    binary = labelled and (row["_classes"], row["_least"], row["_largest"]) == (2, 0.0, 1.0)
    report = {
        "data_path": data_path,
        "row_count": int(row["_rows"]),
        "expected_columns": list(config.source_columns),
        "missing_columns": missing,
        "null_counts": nulls,
        "target_class_count": int(row["_classes"]) if labelled else 0,
        "target_is_binary": bool(binary),
    }
    if report_path:
        one = spark.createDataFrame([(json.dumps(report),)], "value string")
        one.coalesce(1).write.mode("overwrite").text(f"{report_path}/summary")
        if labelled:
            target_classes(df, config.target).write.mode("overwrite").json(f"{report_path}/target_classes")
    if missing:
        raise ValueError(f"The account table lacks these columns: {', '.join(missing)}")
    null_columns = [c for c, n in nulls.items() if n > 0]
    if null_columns:
        raise ValueError(f"These columns must not have nulls: {', '.join(null_columns)}")
    if labelled and not binary:
        raise ValueError(f"{config.target} must take the values 0 and 1, both of them and no other.")
    return report
