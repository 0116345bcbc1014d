"""Stateful streams over several batches against plain loops over all rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    start = datetime(2024, 1, 1)
    times = sorted(start + timedelta(seconds=r.randrange(3 * 86400)) for _ in range(240))
    return [(i, t, r.choice([1, 2, 3]), r.choice(["view", "purchase", "purchase", "error"]), 1.0, f'{{"k": {r.randrange(4)}}}') for i, t in enumerate(times)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "events")
    for i in range(0, 240, 80):  # batches come in order of time
        spark.createDataFrame(rows[i : i + 80], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def collected(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).collect()


def test_rate_limits(spark, rows, folder):
    got = {x.event_id: x.allowed for x in collected(spark, events.rate_limited(events.event_stream(spark, folder), limit=2, seconds=3600, daily=20), "limits")}
    seen, days, want = {}, {}, {}
    for i, at, user, *_ in rows:
        days[user, at.date()] = days.get((user, at.date()), 0) + 1
        recent = [t for t in seen.get(user, []) if t > at - timedelta(seconds=3600)]
        want[i] = len(recent) < 2 and days[user, at.date()] <= 20
        seen.setdefault(user, []).append(at)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_users_are_forgotten(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for i, (user, hours) in enumerate([(1, 0), (2, 60), (2, 61), (2, 62)]):
        spark.createDataFrame([(i, start + timedelta(hours=hours), user, "view", 1.0, "{}")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = events.rate_limited(events.event_stream(spark, str(tmp_path / "in")), limit=2)
    query = frame.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert [r.allowed for r in spark.table("forgotten").collect()] == [True] * 4
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "value").load()
    assert {r.key.user_id if hasattr(r.key, "user_id") else r.key[0] for r in state.select("key").collect()} == {2}


def test_alert_throttles(spark, rows, folder):
    got = {x.event_id: x.sent for x in collected(spark, events.throttled_alerts(events.event_stream(spark, folder)), "alerts")}
    last, topics, want = {}, {}, {}
    minute = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() // 60)
    for i, at, user, kind, _, props in rows:
        if kind != "purchase":
            continue
        now = minute(at)
        want[i] = now - last.get(user, -(10**9)) >= 90 and now - topics.get((user, props), -(10**9)) >= 180
        if want[i]:
            last[user] = topics[user, props] = now
    assert got == want and 0 < sum(want.values()) < len(want)


def test_first_impressions_and_queue(spark, rows, folder):
    stream = lambda: events.event_stream(spark, folder)
    got = collected(spark, events.first_impressions(stream(), "4 days"), "impressions")
    assert len(got) == len({(u, p, t.date()) for _, t, u, k, _, p in rows if k == "view"})
    queue = collected(spark, events.groomed(stream(), "4 days"), "queue")
    assert sorted((x.user_id, x.event_type, x.priority) for x in queue) == sorted((u, k, {"error": 0, "purchase": 1}.get(k, 2)) for u, k in {(u, k) for _, _, u, k, *_ in rows})


def test_repeats_within_the_window_go(spark, folder, rows, tmp_path):
    path = str(tmp_path / "twice")
    for _ in range(2):
        spark.createDataFrame(rows[:50], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = collected(spark, events.deduplicated(events.event_stream(spark, path), within="4 days"), "once")
    assert sorted(x.event_id for x in got) == list(range(50))


def test_running_centroids(spark, tmp_path):
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=4).tolist(), i % 3) for i in range(40)] + [(100, [1.0], 0), (101, None, 0), (102, [float("nan")] * 4, 1)]
    path = str(tmp_path / "v")
    for part in (vectors[:25], vectors[25:]):
        spark.createDataFrame(part, "vec_id long, embedding array<double>, label int").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("vec_id long, embedding array<double>, label int").option("maxFilesPerTrigger", 1).parquet(path)
    got = {}
    for x in collected(spark, events.running_centroids(stream), "centroids_now", "update"):
        if x.n >= got.get(x.label, (0,))[0]:
            got[x.label] = (x.n, x["mean"])
    for label in range(3):
        own = [np.array(e) for i, e, k in vectors if k == label and i < 100]
        assert got[label][0] == len(own) and np.allclose(got[label][1], np.mean(own, axis=0))


def test_ingest_and_publish(spark, folder, tmp_path):
    out, news = str(tmp_path / "out"), str(tmp_path / "news")
    for _ in range(2):  # a second run finds nothing new
        events.ingest(events.event_stream(spark, folder), out, str(tmp_path / "c1"), None).awaitTermination(120)
    assert spark.read.parquet(out).count() == 240
    rows = events.event_stream(spark, folder).select("event_id").filter("event_id < 5")
    events.published(rows, "ingest", news, str(tmp_path / "c2")).awaitTermination(120)
    lines = spark.read.text(news).select(F.get_json_object("value", "$.channel").alias("c"), F.get_json_object("value", "$.data.event_id").alias("i")).collect()
    assert sorted((x.c, x.i) for x in lines) == [("ingest", str(i)) for i in range(5)]
