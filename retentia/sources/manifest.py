"""Tables that are built again when what they were built from has changed.

A table carries a manifest: a digest of its input files (names, sizes and
times) and one of its settings. A later job reuses the table only if it is
whole and both digests are those of now; the original reuses whatever file is
there, however old.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import is_whole, write_table

#: Below the table's folder; readers of the table pass over such names.
MANIFEST = "_manifest"


def files_digest(spark: SparkSession, inputs: Sequence[str]) -> dict[str, Any]:
    """Number, bytes and digest of all files below the input paths. Names,
    sizes and times are listed and hashed by Spark; their order is no matter."""
    count, size, digest = 0, 0, 0
    for path in inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        row = files.select("path", "length", F.unix_millis("modificationTime").alias("changed")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("length").alias("bytes"),
            F.sum(F.xxhash64("path", "length", "changed").cast("decimal(38,0)")).alias("digest"),
        ).first()
        count, size, digest = count + row["n"], size + int(row["bytes"] or 0), digest + int(row["digest"] or 0)
    return {"files": count, "bytes": size, "digest": str(digest)}


def manifest_of(spark: SparkSession, inputs: Sequence[str], settings: Mapping[str, Any]) -> dict[str, Any]:
    text = json.dumps(settings, sort_keys=True, default=str)
    return {"inputs": files_digest(spark, inputs), "settings": hashlib.sha256(text.encode()).hexdigest()}


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The manifest of a whole table, else None."""
    if not (is_whole(spark, path) and is_whole(spark, f"{path}/{MANIFEST}")):
        return None
    return json.loads(spark.read.text(f"{path}/{MANIFEST}").first()["value"])


def ensure_current(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    inputs: Sequence[str],
    settings: Mapping[str, Any],
    write: Callable[[DataFrame, str], None] = write_table,
) -> bool:
    """Build the table at ``path`` unless it is whole and its manifest is that
    of these inputs and settings; True if it was built. ``write`` replaces
    what is there. The manifest is written last, so a table that a failed job
    left behind is built again."""
    now = manifest_of(spark, inputs, settings)
    if read_manifest(spark, path) == now:
        return False
    write(build(), path)
    spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")
    return True
