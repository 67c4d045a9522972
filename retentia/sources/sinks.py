"""Writers: feature tables, train/test splits, reports and scored downloads.

Everything is written by the executors through the DataFrame writer (any
shared file system), never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Feature table (or any table); CSV gets a header row."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_splits(df: DataFrame, path: str, split_column: str = "split", fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Train and test rows in one table partitioned by split, so readers of
    one side prune the other side's files."""
    writer = df.write.mode(mode).partitionBy(split_column)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def is_whole(spark: SparkSession, path: str) -> bool:
    """True if a finished write is there: the folder has its ``_SUCCESS`` mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def ensure_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Materialize only when missing: a whole table is left as it is, one
    that a failed job left behind is written anew."""
    if not is_whole(df.sparkSession, path):
        write_table(df, path, fmt)


def write_report(df: DataFrame, path: str) -> None:
    """A small report table as JSON lines (one file)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_scored_csv(df: DataFrame, path: str) -> None:
    """Scored rows with a header, one file per partition (no driver copy)."""
    df.write.mode("overwrite").option("header", True).csv(path)
