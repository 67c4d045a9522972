"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def launched_by_spark() -> bool:
    """True under ``spark-submit`` or another launcher that names a master."""
    submit = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    return bool(
        os.environ.get("PYSPARK_GATEWAY_PORT")
        or os.environ.get("SPARK_MASTER")
        or "--master" in submit
        or "spark.master" in submit
    )


def get_spark(app_name: str = "retentia", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for the renewal jobs.

    On a cluster the launcher owns master, memory, the shuffle width and the
    checkpoint folder; this only sets what the jobs rely on (AQE, UTC, Arrow,
    no UI), plus the shuffle width when one is passed explicitly. Local runs
    get ``local[cpus]``, a larger driver heap and a shuffle width close to
    the core count.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if not launched_by_spark():
        parts = shuffle_partitions or (8 if cpus == "*" else max(2, int(cpus)))
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.driver.memory", os.environ.get("RETENTIA_DRIVER_MEMORY", "16g"))
            .config("spark.sql.shuffle.partitions", str(parts))
        )
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of this machine is made up only for a local master that names
    none, as in tests; on a cluster a missing setting is an error, since the
    executors would write to their own disks.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="retentia-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def _run_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, for tables that several
    later jobs read: the lineage ends there (a lost executor costs a re-read,
    not a recomputation), readers prune columns and push filters down, and
    with ``partition_by`` a filter on that column prunes whole folders."""
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in this application. Frames that
    read those tables can't be used any more, so this is the last step of a
    job, not of a query."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered_checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: unlike a Parquet table it keeps the order of
    rows and their partitions, which model fits depend on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
