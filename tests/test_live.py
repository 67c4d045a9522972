"""Streams that keep state or write twice: the live gauge, the quarantine,
scoring with the newest model."""

import datetime as dt
import time

from pyspark.sql import functions as F

from retentia.plans import training as TR
from retentia.streaming import accounts as A
from retentia.streaming import gauge as G

T0 = dt.datetime(2024, 5, 1, 12)
LOG = "ts timestamp, failed boolean, endpoint string"


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # the file source orders files by modification time


def test_gauge_equals_batch_after_a_restart_and_counts_late_rows(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("log", "gauge", "ck"))

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
        G.keep_gauge(G.live_gauge(stream, "endpoint", idle_after_ms=600_000), out, checkpoint).awaitTermination()

    put(spark, src, [(at(i), i % 4 == 0, "score") for i in range(200)] + [(at(3), False, None), (at(4), True, "")], LOG)
    put(spark, src, [(at(300), True, "explain"), (None, None, "score")], LOG)
    run()
    changed = spark.read.schema(f"{G.GAUGE}, batch bigint").parquet(out)
    assert {r.key for r in changed.where("batch = 1").collect()} == {"explain", "score"}  # changed keys only
    # a second run finds its counters; one row is hours late
    put(spark, src, [(at(301), False, "explain"), (at(-500), True, "explain")], LOG)
    run()
    want = G.gauge_table(spark.read.parquet(src), "endpoint")
    got = G.latest_gauge(spark, out)
    columns = ["key", "requests", "errors", "error_rate", "last_seen"]
    assert got.count() == 4
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0
    row = got.where("key = 'explain'").first()
    assert (row.requests, row.errors, row.last_seen, row.idle) == (3, 2, at(301), False)


def test_quiet_keys_are_marked_idle_once(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("log", "gauge", "ck"))

    def run():
        stream = spark.readStream.schema(LOG).parquet(src)
        G.keep_gauge(G.live_gauge(stream, "endpoint", idle_after_ms=1), out, checkpoint).awaitTermination()

    put(spark, src, [(at(0), False, "a")], LOG)
    run()
    put(spark, src, [(at(1), False, "b")], LOG)
    run()
    put(spark, src, [(at(2), True, "a")], LOG)
    run()
    rows = [(r.batch, r.key, r.requests, r.idle) for r in spark.read.schema(f"{G.GAUGE}, batch bigint").parquet(out).collect()]
    assert [r for r in sorted(rows) if r[1] == "a" and r[3]] in ([(1, "a", 1, True)], [(1, "a", 1, True), (2, "a", 2, True)])
    assert (rows.count((0, "a", 1, False)), rows.count((2, "a", 2, False))) == (1, 1)


ACCOUNT = (
    "account_id long, monthly_usage_hours double, login_frequency double, last_login_days double, "
    "support_tickets double, payment_failures double, subscription_plan string"
)


def account(i, hours=10.0, plan="growth"):
    return (i, hours, 5.0, 3.0, 1.0, 0.0, plan)


def test_quarantine_deals_every_row_out_once(spark, tmp_path):
    src, good, bad, checkpoint = (str(tmp_path / n) for n in ("in", "good", "bad", "ck"))
    put(spark, src, [account(1), account(2, -4.0), account(3, plan="x"), account(4, None)], ACCOUNT)
    put(spark, src, [account(5), account(5), account(6, plan=None)], ACCOUNT)
    stream = spark.readStream.schema(ACCOUNT).option("maxFilesPerTrigger", 1).parquet(src)
    A.quarantine_stream(stream, good, bad, checkpoint).awaitTermination()
    # the last batch runs again, as after a lost driver
    A.split_batch(spark.read.schema(ACCOUNT).parquet(src).where("account_id > 4"), 1, good, bad)
    kept, gone = A.read_batches(spark, good), A.read_batches(spark, bad)
    assert sorted(r.account_id for r in kept.collect()) == [1, 5, 5]
    assert {r.account_id: r.violations for r in gone.collect()} == {
        2: "monthly_usage_hours:negative",
        3: "subscription_plan:length",
        4: "monthly_usage_hours:missing",
        6: "subscription_plan:missing",
    }
    assert kept.count() + gone.count() == 7
    assert {(r.account_id, r.batch) for r in kept.select("account_id", "batch").collect()} == {(1, 0), (5, 1)}


def test_scoring_follows_the_newest_model(spark, tmp_path):
    from test_training import _signal
    from retentia.config import DEFAULT_CONFIG
    from retentia.operators.split import stratified_split

    cfg = DEFAULT_CONFIG.with_(gbt_ranges=(("n_estimators", (3, 5)),) + DEFAULT_CONFIG.gbt_ranges[1:])
    src, out, checkpoint, bundles = (str(tmp_path / n) for n in ("in", "out", "ck", "bundles"))
    bundle = TR.fit_and_evaluate(stratified_split(_signal(spark, 300)), cfg, n_trials=1)
    versions = [TR.save_bundle(bundle, bundles)]

    def run():
        stream = spark.readStream.schema(ACCOUNT).parquet(src)
        A.scoring_stream(stream, bundles, out, checkpoint, cfg).awaitTermination()

    put(spark, src, [account(i) for i in range(5)], ACCOUNT)
    run()
    versions.append(TR.save_bundle(bundle, bundles))
    put(spark, src, [account(i) for i in range(5, 12)], ACCOUNT)
    run()
    got = A.read_batches(spark, out)
    by = {r.model_version: r["count"] for r in got.groupBy("model_version").count().collect()}
    assert by == {v.rsplit("/", 1)[-1]: n for v, n in zip(versions, (5, 7))}
    batch = TR.score_accounts(bundle, spark.read.schema(ACCOUNT).parquet(src), cfg)
    assert got.select(*batch.columns).exceptAll(batch).count() == 0
    assert got.where(F.col("renewal_probability").isNull()).count() == 0
