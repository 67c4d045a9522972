"""Scoring-request monitoring (re-aimed from in-process counters).

The original keeps request / error counters, a latency histogram, an error
rate gauge, and a dashboard that plots the 5-minute request rate. Here the
requests are a log (a table or a stream) and the same numbers are
aggregations over it:

* ``request_totals``    requests and errors (failed requests still count);
* ``latency_histogram`` cumulative bucket counts (``le``), sum and count;
* ``error_rate``        errors / requests;
* ``request_rate``      requests per second over 5-minute event-time windows.

Every function works on a batch DataFrame and on a streaming one. Streams use
a watermark (ours: 10 minutes) so windowed state is dropped once late data
can no longer arrive; whole-log totals run in ``complete`` mode.

Test data mapping: ``events`` rows are requests, ``ts`` is the time,
``value / 100`` the latency in seconds, ``event_type = 'error'`` a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import LATENCY_BUCKETS, RATE_SLIDE, RATE_WINDOW, STREAM_WATERMARK


def request_log(events: DataFrame) -> DataFrame:
    """``events`` -> ``(ts, latency_seconds, failed)``."""
    return events.select(
        F.col("ts"),
        (F.col("value") / F.lit(100.0)).alias("latency_seconds"),
        (F.col("event_type") == F.lit("error")).alias("failed"),
    )


def request_totals(log: DataFrame) -> DataFrame:
    """``(requests, errors)``; failures are never filtered out first."""
    return log.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("failed"), 1)).alias("errors"),
    )


def latency_histogram(log: DataFrame) -> DataFrame:
    """``(le, bucket_count, latency_sum, latency_count)``: cumulative counts
    per upper bound, ``+Inf`` last, in one aggregation pass."""
    lat = F.col("latency_seconds")
    labels = [_le_label(b) for b in LATENCY_BUCKETS] + ["+Inf"]
    aggs = [F.count(F.when(lat <= F.lit(b), 1)).alias(f"b{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    aggs += [F.count(F.lit(1)).alias(f"b{len(LATENCY_BUCKETS)}"), F.sum(lat).alias("latency_sum"), F.count(F.lit(1)).alias("latency_count")]
    wide = log.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(label).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, label in enumerate(labels)])
    return wide.select(F.inline(rows), "latency_sum", "latency_count")


def _le_label(bound: float) -> str:
    return repr(float(bound))


def error_rate(log: DataFrame) -> DataFrame:
    """``(requests, errors, error_rate)``."""
    totals = request_totals(log)
    return totals.select(
        "requests",
        "errors",
        F.when(F.col("requests") == 0, F.lit(0.0)).otherwise(F.col("errors") / F.col("requests")).alias("error_rate"),
    )


def request_rate(log: DataFrame, window: str = RATE_WINDOW, slide: str | None = None) -> DataFrame:
    """``(window_start, window_end, requests, errors, request_rate)``:
    requests per second in each event-time window (tumbling unless a
    ``slide`` is given; the dashboard's is 5 minutes every 15 seconds)."""
    seconds = _seconds(window)
    counts = lambda a, b: (a.alias("requests"), b.alias("errors"))
    w = F.window("ts", slide or window)
    grouped = log.groupBy(w.alias("w")).agg(*counts(F.count(F.lit(1)), F.count(F.when(F.col("failed"), 1))))
    if slide:
        # panes of one slide are counted first; only they are dealt out to the windows they lie in
        rolled = F.window(F.window_time("w"), window, slide)
        grouped = grouped.groupBy(rolled.alias("r")).agg(*counts(F.sum("requests"), F.sum("errors")))
        grouped = grouped.withColumnRenamed("r", "w")
    return grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "requests",
        "errors",
        (F.col("requests") / F.lit(float(seconds))).alias("request_rate"),
    )


def _seconds(interval: str) -> int:
    amount, unit = interval.split()
    scale = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return int(amount) * scale


# -- streaming -----------------------------------------------------------------


def event_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A stream over a folder of event parquet files (new files = new data)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_event_time(log: DataFrame) -> DataFrame:
    """Watermarks need an instant type: a local (NTZ) time is read as a time
    in the session zone (UTC in our sessions)."""
    if isinstance(log.schema["ts"].dataType, T.TimestampNTZType):
        return log.withColumn("ts", F.col("ts").cast(T.TimestampType()))
    return log


def windowed_rate_stream(log: DataFrame, window: str = RATE_WINDOW, slide: str | None = RATE_SLIDE, watermark: str = STREAM_WATERMARK) -> DataFrame:
    """Streaming request rate with a watermark on event time."""
    return request_rate(with_event_time(log).withWatermark("ts", watermark), window, slide)


def start_monitor(
    df: DataFrame,
    name: str,
    checkpoint: str,
    output_mode: str,
    sink: str = "parquet",
    path: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start one monitoring query; the checkpoint folder keeps its progress
    and state so a restarted driver resumes where it stopped.

    File sinks (append mode) need a ``path``. ``memory`` keeps all rows on the
    driver, for tests and small totals only."""
    if sink != "memory" and not path:
        raise ValueError(f"a {sink} sink needs a path")
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if sink == "memory":
        writer = writer.format("memory").queryName(name)
    else:
        writer = writer.format(sink).option("path", path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
