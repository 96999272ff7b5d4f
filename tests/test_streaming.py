"""Streams against their batch twins."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkpulse.streaming import jobs


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        path = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(schema).parquet(path)

    return make


def finished(spark, df, tmp_path, mode="append"):
    jobs.start(df, str(tmp_path / "out"), str(tmp_path / "ck"), mode).awaitTermination(90)
    return spark.read.parquet(str(tmp_path / "out"))


def test_windows_agree_with_the_batch(spark, stream, tmp_path):
    rows = [(at(0), "a"), (at(1), "a"), (at(7), "b"), (at(600), "z")]
    df = stream(rows, "ts timestamp, event_type string")
    got = finished(spark, jobs.tumbling_counts(df), tmp_path)
    want = jobs.tumbling_counts(spark.createDataFrame(rows, "ts timestamp, event_type string")).where("event_type <> 'z'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeats_are_written_once(spark, stream, tmp_path):
    df = stream([(at(0), 1, 5.0), (at(1), 1, 5.0), (at(2), 2, 99.0)], "ts timestamp, id long, v double")
    assert [r.id for r in finished(spark, jobs.validated_stream(df, ["id"], {"v": (0, 10)}), tmp_path).collect()] == [1]


def test_playback_stream_closes_sessions(spark, stream, tmp_path):
    rows = [(1, at(0), 1, "start"), (1, at(1), 2, "buffering"), (1, at(2), 3, "buffering"), (1, at(3), 4, "buffering"), (1, at(4), 5, "end"), (2, at(0), 6, "end")]
    schema = "user_id long, ts timestamp, event_id long, event_type string"
    got = finished(spark, jobs.playback_stream(stream(rows, schema)), tmp_path)
    twin = jobs.playback_sessions(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in got.select("user_id", "duration_s", "bufferings", "alerts").collect()] == [tuple(r) for r in twin.select("user_id", "duration_s", "bufferings", "alerts").collect()] == [(1, 240.0, 3, 1)]


def test_alert_stream_keeps_the_cooldown(spark, stream, tmp_path):
    df = stream([("m", at(0), 0.75), ("m", at(5), 0.8), ("m", at(10), 0.95), ("m", at(20), 0.6), ("m", at(25), 0.6)], "machine string, ts timestamp, score double")
    assert sorted(r.score for r in finished(spark, jobs.alert_stream(df), tmp_path).collect()) == [0.6, 0.75, 0.95]


def test_dispatch_stream_serves_orders_from_latest_pings(spark, stream, tmp_path):
    schema = "kind string, driver_id long, ts timestamp, lat double, lon double, status string, order_id string"
    df = stream([("ping", 1, at(0), 0.0, 0.0, "IDLE", None), ("ping", 1, at(1), 9.0, 9.0, "BUSY", None), ("ping", 2, at(0), 5.0, 5.0, "IDLE", None), ("order", None, at(2), 0.1, 0.1, None, "o")], schema)
    jobs.dispatch_stream(df, str(tmp_path / "state"), str(tmp_path / "served"), str(tmp_path / "ck")).awaitTermination(90)
    assert [(r.order_id, r.driver_id) for r in spark.read.parquet(str(tmp_path / "served")).collect()] == [("o", 2)]


def test_keyword_route_blocks_first(spark):
    posts = spark.createDataFrame([("u", "Tech news", "x"), ("v", "nothing", "ai"), ("w", "Tech", "x")], "user string, text string, topic string")
    blocked = spark.createDataFrame([("w",)], "user string")
    assert sorted(r.user for r in jobs.keyword_route(posts, ["Tech"], "ai", blocked).collect()) == ["u", "v"]


def test_cdc_bonus_latches_once(spark):
    df = spark.createDataFrame([(1, at(0), None, 5.0), (1, at(1), 10, None), (1, at(2), 16, None), (1, at(3), 17, None)], "d long, ts timestamp, trips_in int, rating_in double")
    out = jobs.cdc_state(df, "d", "ts", F.col("trips_in"), F.col("rating_in")).orderBy("ts").collect()
    assert [r.earns_bonus for r in out] == [False, False, True, False]


def test_changed_windows_reach_the_console_sink(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:02", "a")], "ts string, event_type string").write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("ts string, event_type string").json(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.to_console(jobs.tumbling_counts(events), kind="memory", name="printed").awaitTermination()
    assert [r["n"] for r in spark.table("printed").collect()] == [2]


CDC = "user_id long, ts timestamp, event_id long, trips_in int, rating_in double"


def changes(n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), at(k // 2), k, rng.choice([None, rng.randrange(10, 20)]), rng.choice([None, 4.0 + rng.random()])) for k in range(n)]
    for k in range(0, n - 8, 8):  # out of order, by four minutes at most
        part = rows[k : k + 8]
        rng.shuffle(part)
        rows[k : k + 8] = part
    return rows


def test_cdc_stream_agrees_with_its_twin_across_a_restart(spark, stream, tmp_path):
    rows, seen = changes(240, 3), []
    for k in (0, 80, 160):  # each run begins at the checkpoint of the one before
        df = stream(rows[k : k + 80], CDC)
        seen += rows[k : k + 80]
        got = finished(spark, jobs.cdc_stream(df, F.col("trips_in"), F.col("rating_in")), tmp_path)
    passed = max(r[1] for r in rows) - timedelta(minutes=10)
    want = jobs.cdc_state(spark.createDataFrame(rows, CDC), "user_id", ["ts", "event_id"], F.col("trips_in"), F.col("rating_in")).where(F.col("ts") <= F.lit(passed))
    columns = ["user_id", "ts", "event_id", "trips", "rating", "earns_bonus"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert got.where("earns_bonus").count() == got.where("earns_bonus").select("user_id").distinct().count() > 1


def test_cdc_state_goes_after_an_idle_time(spark, stream, tmp_path):
    day = 24 * 60
    rows = [(1, at(0), 1, 16, 4.9), (1, at(5), 2, 17, None), (2, at(3 * day), 3, 1, None), (1, at(6 * day), 4, None, 4.9), (2, at(9 * day), 5, 1, None)]
    out = []
    for r in rows:  # a batch each, so that the watermark passes between them
        out = finished(spark, jobs.cdc_stream(stream([r], CDC), F.col("trips_in"), F.col("rating_in"), idle_days=2), tmp_path)
    got = {r.event_id: (r.trips, r.rating, r.earns_bonus) for r in out.collect()}
    assert got == {1: (16, 4.9, True), 2: (17, 4.9, False), 3: (1, 5.0, False), 4: (0, 4.9, False)}


def test_counters_of_a_restarted_stream_add_up(spark, stream, tmp_path):
    schema, bounds, counters = "ts timestamp, id long, v double", {"v": (0.0, 10.0)}, str(tmp_path / "counters")
    listener = jobs.IngestCounters(spark, counters)
    spark.streams.addListener(listener)
    try:
        rows = [(at(k), k, float(k % 14)) if k % 9 else (None, k, None) for k in range(60)]
        for k in (0, 25, 26):
            finished(spark, jobs.validated_stream(stream(rows[k : {0: 25, 25: 26, 26: 60}[k]], schema), ["id"], bounds), tmp_path)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        want = tuple(jobs.ingest_counts(spark.createDataFrame(rows, schema), bounds).first())
        for _ in range(100):
            if os.path.isdir(counters) and tuple(jobs.ingest_totals(spark, counters).first())[1:] == (3, *want):
                break
            time.sleep(0.2)
        assert tuple(jobs.ingest_totals(spark, counters).first())[1:] == (3, *want)
    finally:
        spark.streams.removeListener(listener)


def test_keyword_route_as_a_stream(spark, stream, tmp_path):
    rows = [("u", "Tech news", "x"), ("v", "nothing", "ai"), ("w", "Tech", "x"), ("x", None, None)]
    blocked = spark.createDataFrame([("w",)], "user string")
    got = finished(spark, jobs.keyword_route(stream(rows, "user string, text string, topic string"), ["Tech"], "ai", blocked), tmp_path)
    assert sorted(r.user for r in got.collect()) == ["u", "v"]


def test_exactly_once_ingest_across_a_restart(spark, stream, tmp_path):
    schema = "ts timestamp, id long"
    for rows in ([(at(0), 1), (at(0), 1), (at(1), 2)], [(at(2), 2), (at(3), 3)]):
        jobs.exactly_once(stream(rows, schema), "id", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
