"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A folder of this machine is made up only for a local master that names
    none (tests); on a cluster a missing setting is an error, since executors
    would otherwise write to their own disks.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="retentia-shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables and archives. Frames that
    read them can't be used any more: the last step of a job, not of a query."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch that goes to a Python worker while whole texts do.
TEXT_BATCH_ROWS = 1000


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Small batches for the actions inside: a batch of whole texts is held by
    the executor and by the worker at once."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(TEXT_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: the lineage ends there,
    so that a lost executor costs a re-read and no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with text_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a stored table up to which it may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most
    ``rows`` rows; a larger one is left to an ordinary join."""
    return F.broadcast(stored) if stored.count() <= rows else stored
