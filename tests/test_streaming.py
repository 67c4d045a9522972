import os
import time

import pytest
from pyspark.sql import functions as F

from retentia.sources.accounts import account_table
from retentia.streaming import requests as R
from retentia.streaming.scoring import account_stream, score_stream_stand_in
from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_totals_and_rate_equal_batch_twins(spark, tmp_path):
    events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    src = str(tmp_path / "events")
    # append four time-ordered slices, one file each -> four micro-batches
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / 4
    for i in range(4):
        start, end = lo + step * i, (lo + step * (i + 1) if i < 3 else hi + step)
        events.where((F.col("ts") >= start) & (F.col("ts") < end)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # file source orders files by modification time
    stream = R.event_stream(spark, src, events.schema, max_files=1)
    log = R.request_log(stream)

    q1 = R.start_monitor(R.request_totals(log), "totals_t", str(tmp_path / "ck1"), "complete", "memory")
    q1.awaitTermination()
    q2 = R.start_monitor(R.windowed_rate_stream(log, "5 minutes", None), "rate_t",
                         str(tmp_path / "ck2"), "append", "memory")
    q2.awaitTermination()
    batch_log = R.request_log(events)
    assert _rows(spark.table("totals_t")) == _rows(R.request_totals(batch_log))
    # append mode emits windows that the watermark has closed; the rest are
    # still open and would be emitted by later data
    streamed = spark.table("rate_t")
    batch = R.request_rate(R.with_event_time(batch_log), "5 minutes")
    assert streamed.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def test_sliding_rate_stream_runs(spark, tmp_path):
    events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    src = str(tmp_path / "ev")
    events.write.parquet(src)
    log = R.request_log(R.event_stream(spark, src, events.schema))
    q = R.start_monitor(R.windowed_rate_stream(log), "slide_t", str(tmp_path / "ck"), "append", path=str(tmp_path / "out"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    five = F.col("window_start") + F.expr("INTERVAL 5 MINUTES")
    assert out.where(F.col("window_end") != five).count() == 0
    # every window that the watermark has closed has the batch form's counts
    batch = R.request_rate(R.with_event_time(R.request_log(events)), "5 minutes", "15 seconds")
    assert out.count() > 0 and out.exceptAll(batch).count() == 0
    # and the batch form has those of the windows themselves
    log = R.with_event_time(R.request_log(events))
    plain = log.groupBy(F.window("ts", "5 minutes", "15 seconds").alias("w")).count()
    plain = plain.select(F.col("w.start").alias("window_start"), F.col("count").alias("requests"))
    assert batch.select("window_start", "requests").exceptAll(plain).count() == 0 and batch.count() == plain.count()


def test_file_sinks_need_a_path(spark, tmp_path):
    with pytest.raises(ValueError, match="needs a path"):
        R.start_monitor(spark.readStream.format("rate").load(), "x", str(tmp_path / "ck"), "append")


def test_latency_histogram_is_cumulative(spark):
    events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    hist = R.latency_histogram(R.request_log(events)).collect()
    counts = [r["bucket_count"] for r in hist]
    assert counts == sorted(counts) and hist[-1]["le"] == "+Inf" and counts[-1] == events.count()


def test_stream_scoring_equals_batch(spark, tmp_path):
    acc = account_table(spark, SF_SMALL)
    src = str(tmp_path / "acc")
    acc.repartition(3).write.parquet(src)
    stream = account_stream(spark, src, acc.schema)
    q = R.start_monitor(score_stream_stand_in(stream), "scored_t", str(tmp_path / "ck"), "append", "memory")
    q.awaitTermination()
    batch = score_stream_stand_in(spark.read.parquet(src))
    streamed = spark.table("scored_t")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0
