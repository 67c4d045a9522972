"""Readers for the parquet tables and for account files."""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "input") -> None:
    """Fail fast, naming every absent column (a driver-side schema check)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required {what} columns: {', '.join(missing)}")


def load_accounts(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    fmt: str = "csv",
    optional: Sequence[str] = (),
) -> DataFrame:
    """Scan an account file or folder and project it to ``columns`` and those
    of ``optional`` that it has.

    CSV is read with a header and all text, so that numeric coercion decides
    what parses; other formats keep their own schema. Only the projected
    columns reach the scan.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    require_columns(df, columns, "source")
    return df.select(*columns, *[c for c in optional if c in df.columns and c not in columns])


BROKEN = "_broken_line"


def load_accounts_apart(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A CSV account file or folder as two frames: the rows of lines that have
    the header's fields, projected to ``columns``, and the lines that have
    more or fewer: (file, first_field, line). Every line is in one of them.

    The reader pads or cuts broken lines silently unless the schema has a
    column for them, and counts the fields of a line only if it prunes none.
    """
    names = spark.read.option("header", True).csv(path).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"Missing required source columns: {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in [*names, BROKEN])
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    lines = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", BROKEN).csv(path)
    good = lines.where(F.col(BROKEN).isNull()).select(*columns)
    broken = lines.where(F.col(BROKEN).isNotNull())
    return good, broken.select(
        F.col("_metadata.file_name").alias("file"), F.col(f"`{names[0]}`").alias("first_field"), F.col(BROKEN).alias("line")
    )
