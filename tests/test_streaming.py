from pyspark.sql import functions as F

from tidewire.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    batch.repartition(2).write.parquet(folder)
    stream = events.hourly_counts(events.event_stream(spark, folder).drop("props"), "60 days")
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = events.hourly_counts(batch)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, want.collect()))


def run_stream(spark, make, folder, name, mode):
    query = make(events.event_stream(spark, str(folder))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def landed(spark, folder):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, f"2024-01-01 {h:02d}:00:00", u, k) for i, (h, u, k) in enumerate([(1, 1, "view"), (2, 1, "error"), (3, 1, "click"), (4, 1, "click"), (1, 2, "error"), (2, 2, "view")])]
    rows.append((9, "2024-01-09 00:00:00", 3, "view"))
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    frame.selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "1.0d value", "'{}' props").to(spark.createDataFrame([], schema).schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_streaks_carry_over_batches(spark, tmp_path):
    landed(spark, tmp_path / "in")
    got = {r.user_id: (r.run, r.paused) for r in run_stream(spark, events.streaks, tmp_path / "in", "streaks", "update")}
    assert got == {1: (3, True), 2: (0, False), 3: (0, False)}
    landed(spark, tmp_path / "two")
    landed(spark, tmp_path / "two")
    only = lambda s: events.streaks(s.filter("event_type <> 'view'"))
    assert max(r.run for r in run_stream(spark, only, tmp_path / "two", "streaks2", "update") if r.user_id == 1) == 6


def test_sessions_and_sliding_windows(spark, tmp_path):
    landed(spark, tmp_path / "in")
    got = run_stream(spark, events.sessions, tmp_path / "in", "sessions", "complete")
    assert sorted((r.event_type, r.n) for r in got) == [("click", 2), ("error", 2), ("view", 1), ("view", 2)]
    got = run_stream(spark, events.sliding_counts, tmp_path / "in", "sliding", "complete")
    assert sum(r.n for r in got) == 7 * 4


def test_restamped_keeps_every_row(spark, tmp_path):
    landed(spark, tmp_path / "in")
    got = run_stream(spark, lambda s: events.restamped(s, "2024-01-05 00:00:00"), tmp_path / "in", "stamped", "append")
    assert len(got) == 7 and str(max(r.ts for r in got)) == "2024-01-05 00:00:00"
