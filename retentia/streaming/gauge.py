"""A live gauge of scoring requests: cumulative counters that survive a restart.

The original keeps its request and error counters, and the error-rate gauge
read off them, in the memory of one process. Here each key (an endpoint, a
model, a kind of request) has counters and a timer in the state store of the
query; a restarted driver finds them in its checkpoint.

* Each micro-batch is summed up per key and task before it is dealt out, so a
  key that holds a third of all requests sends one row per task to its state.
* Only keys that the batch has changed come out, with their new totals.
* A key without requests for ``idle_after`` of processing time comes out once
  more, marked idle; its next request clears the mark.
* Late rows: counters are cumulative, so a request counts whenever it arrives,
  however old it is; ``last_seen`` is the latest event time and never moves
  back. No watermark is set, so none is dropped. A null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAUGE = "key string, requests bigint, errors bigint, error_rate double, last_seen timestamp, idle boolean"


#: ``last_seen``: microseconds since 1970.
COUNTERS = "requests bigint, errors bigint, last_seen bigint"


def _counted(idle_ms: int):
    """What a key's state does with the rows of a batch, or when its timer ends."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        requests, errors, last_seen = state.get if state.exists else (0, 0, None)
        idle = state.hasTimedOut
        for part in () if idle else parts:
            requests, errors = requests + int(part["requests"].sum()), errors + int(part["errors"].sum())
            seen = part["last_seen"].dropna()
            if len(seen):
                latest = int(seen.max())
                last_seen = latest if last_seen is None else max(last_seen, latest)
        state.update((requests, errors, last_seen))
        if not idle:
            state.setTimeoutDuration(idle_ms)
        row = {"key": [key[0][1:] if key[0] else None], "requests": [requests], "errors": [errors]}
        rate = errors / requests if requests else 0.0
        yield pd.DataFrame(row | {"error_rate": [rate], "last_seen": pd.to_datetime([last_seen], unit="us", utc=True), "idle": [idle]})

    return update


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of each batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("name", use_threads=False)
        out = table.aggregate([("failed", "count"), ("failed", "sum"), ("seen", "max")])
        named = out.select(["name", "failed_count", "failed_sum", "seen_max"]).rename_columns(["name", "requests", "errors", "last_seen"])
        kinds = [("name", pa.string()), *((n, pa.int64()) for n in ("requests", "errors", "last_seen"))]
        yield from named.cast(pa.schema(kinds)).to_batches()


def live_gauge(log: DataFrame, key: str, idle_after_ms: int = 300_000) -> DataFrame:
    """``GAUGE`` rows of the keys that each micro-batch of the request log
    (ts, failed, ``key``) changes; an update stream."""
    named = log.select(
        # a null key is the empty name, others start with a sign
        F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.lit("")).alias("name"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seen"),
        F.coalesce(F.col("failed"), F.lit(False)).cast("int").alias("failed"),
    )
    partial = named.mapInArrow(_summed, "name string, requests bigint, errors bigint, last_seen bigint")
    return partial.groupBy("name").applyInPandasWithState(
        _counted(idle_after_ms), GAUGE, COUNTERS, "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def gauge_table(log: DataFrame, key: str) -> DataFrame:
    """The batch twin: (key, requests, errors, error_rate, last_seen)."""
    counts = log.groupBy(F.col(key).cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"), F.max(F.col("ts").cast("timestamp")).alias("last_seen")
    )
    rate = F.col("errors") / F.col("requests")
    return counts.select("key", "requests", "errors", rate.alias("error_rate"), "last_seen")


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def keep_gauge(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the gauge, on what has arrived or on and on; each batch's changed
    rows are a folder of ``path`` by batch number, written anew if the batch
    runs again. Timers ask for batches without data for ever, so a run over
    what has arrived goes without those; its timers end with later rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if not available_now:
        return writer.start()
    conf = stream.sparkSession.conf
    before = conf.get(NO_DATA_BATCHES)
    conf.set(NO_DATA_BATCHES, "false")  # a query keeps the settings it was started with
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(NO_DATA_BATCHES, before)


def latest_gauge(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.schema(f"{GAUGE}, batch bigint").parquet(path)
    # an idle mark and new requests of one batch: the requests come later
    newest = F.max_by(F.struct("requests", "errors", "error_rate", "last_seen", "idle"), F.struct("batch", "requests", ~F.col("idle")))
    return rows.groupBy("key").agg(newest.alias("g")).select("key", "g.*")
