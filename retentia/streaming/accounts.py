"""Account records on a stream: quarantine of bad rows, and scoring with the
newest published model.

Both write per micro-batch through ``foreachBatch``, each batch into a folder
named by its number that is written as a whole. Spark runs a batch again if
the driver is lost before the batch is recorded; it then replaces that folder,
so that no row is written twice and none is lost.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_CONFIG, RenewalConfig
from ..operators.quality import split_by_contract

BATCH = "batch"


def _folder(path: str, number: int) -> str:
    return f"{path}/{BATCH}={number}"


def _started(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def split_batch(rows: DataFrame, number: int, good_path: str, quarantine_path: str) -> None:
    """The rows of a batch that keep the contract, and those that break it with
    the codes of what they break, each into the batch's folder."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for part, path in zip(split_by_contract(rows), (good_path, quarantine_path)):
            part.write.mode("overwrite").parquet(_folder(path, number))
    finally:
        rows.unpersist()


def quarantine_stream(
    accounts: DataFrame, good_path: str, quarantine_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Deal a stream of account records out to two tables by the row contract."""
    return _started(accounts, lambda rows, n: split_batch(rows, n, good_path, quarantine_path), checkpoint, available_now)


def score_batch(rows: DataFrame, number: int, bundles: str, path: str, config: RenewalConfig = DEFAULT_CONFIG) -> None:
    """Score a batch with the newest whole bundle at the time it runs."""
    from ..plans.training import load_bundle, score_accounts

    bundle = load_bundle(rows.sparkSession, bundles)
    scored = score_accounts(bundle, rows, config).withColumn("model_version", F.lit(bundle.version))
    scored.write.mode("overwrite").parquet(_folder(path, number))


def scoring_stream(
    accounts: DataFrame, bundles: str, path: str, checkpoint: str, config: RenewalConfig = DEFAULT_CONFIG, available_now: bool = True
) -> StreamingQuery:
    """Score a stream of account records; a model that is published while the
    stream runs serves from the next micro-batch on. Every prediction carries
    the version of the model that made it."""
    return _started(accounts, lambda rows, n: score_batch(rows, n, bundles, path, config), checkpoint, available_now)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches written so far, with their number."""
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
