"""A stored profile per input file: row counts, null counts and class counts.

Profiles are sums, so those of single files add up to that of the table. Files
whose profile is stored with the same size and time are not read again: a new
load costs its own files only. A file that has changed is profiled anew and
its old profile no longer counts; so is the profile of a file that is gone.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_numeric

PROFILE = "path string, bytes bigint, changed bigint, row_count bigint, nulls map<string, bigint>, classes map<double, bigint>"


def input_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = (".parquet", ".csv")) -> DataFrame:
    """(path, bytes, changed) of the data files below a folder, listed by the
    executors' file index (names and sizes only)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.col("path").endswith(suffix)
    return listed.where(wanted).select("path", F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("changed"))


def profile_of(rows: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``PROFILE`` rows of a file source, one per file; one pass. ``classes``:
    how often each number of the target occurs (text that is none is left out)."""
    source = F.col("_metadata")
    file = [source["file_path"].alias("path"), source["file_size"].alias("bytes"), F.unix_millis(source["file_modification_time"]).alias("changed")]
    tagged = rows.select(*file, *[F.col(f"`{c}`").isNull().alias(f"n{i}") for i, c in enumerate(columns)], parse_numeric(target, rows.schema[target].dataType).cast("double").alias("y"))
    y = F.nanvl("y", F.lit(None).cast("double"))
    # (file, class) first: a file has few classes
    counted = tagged.groupBy("path", "bytes", "changed", y.alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"n{i}").alias(f"n{i}") for i in range(len(columns))]
    )
    nulls = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.sum(f"n{i}"))])
    classes = F.map_from_entries(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("y", "n"))))
    return counted.groupBy("path", "bytes", "changed").agg(F.sum("n").alias("row_count"), nulls.alias("nulls"), classes.alias("classes"))


def stored_profiles(spark: SparkSession, store: str) -> DataFrame | None:
    """What the store holds; None before the first update."""
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(PROFILE).option("recursiveFileLookup", "true").parquet(store)


def update_profiles(spark: SparkSession, folder: str, store: str, columns: Sequence[str], target: str, fmt: str = "parquet") -> int:
    """Profile the files of ``folder`` that the store does not know as they
    are now; gives the number of files read."""
    files, known = input_files(spark, folder), stored_profiles(spark, store)
    new = files if known is None else files.join(known.select("path", "bytes", "changed"), ["path", "bytes", "changed"], "left_anti")
    paths = [r["path"] for r in new.select("path").collect()]  # the files of one load
    if paths:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        made = profile_of(reader.format(fmt).load(paths), columns, target)
        load = f"{store}/load-{uuid.uuid4().hex}"
        made.write.parquet(load)
        # a file without rows has a profile too, or it would be read each time
        empty = new.join(spark.read.schema(PROFILE).parquet(load), ["path", "bytes", "changed"], "left_anti")
        none = [F.lit(0).cast("bigint").alias("row_count"), F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.lit(0).cast("bigint")] * len(columns))).alias("nulls")]
        no_class = F.create_map().cast("map<double, bigint>").alias("classes")
        empty.select("path", "bytes", "changed", *none, no_class).write.parquet(f"{load}-empty")
    return len(paths)


def current_profiles(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """The profiles of the files that are there now."""
    keys = ["path", "bytes", "changed"]
    files = input_files(spark, folder)
    # two updates at once may both have profiled a file
    return stored_profiles(spark, store).join(files, keys, "left_semi").dropDuplicates(keys)


def table_profile(profiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(measure, name, value) of the whole table: ``rows``, ``nulls`` by
    column, ``class`` by number, ``files``."""
    rows = profiles.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files"))
    totals = rows.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit("").alias("name"), F.col(m).alias("value")) for m in ("rows", "files")])))
    nulls = profiles.select(F.explode("nulls").alias("name", "value")).groupBy("name").agg(F.sum("value").alias("value"))
    classes = profiles.select(F.explode("classes").alias("class", "value")).groupBy(F.col("class").cast("string").alias("name")).agg(F.sum("value").alias("value"))
    wanted = F.col("name").isin(*columns)
    return totals.unionByName(nulls.where(wanted).select(F.lit("nulls").alias("measure"), "name", "value")).unionByName(
        classes.select(F.lit("class").alias("measure"), "name", "value")
    )
