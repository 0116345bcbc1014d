"""Event streams: deduplication in a window, and tumbling counts, with watermarks for late rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.scalars import entry_time


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of Parquet files as they land in `folder`."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def deduplicated(events: DataFrame, key: str = "event_id", within: str = "12 hours") -> DataFrame:
    """The first row of each key; a repeat within the window is dropped (T-2)."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type; rows later than `late` no longer count (T-8)."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("hour"), "event_type", "n")
    )


def restamped(events: DataFrame, now: str) -> DataFrame:
    """Times far ahead of the clock or long past are set to it before the watermark, so no such row is lost (T-3)."""
    at = entry_time(F.col("ts").cast("timestamp_ntz"), now).cast("timestamp")
    return events.withColumn("ts", at)


def sessions(events: DataFrame, gap: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """Runs of each type's events without a pause of `gap` (T-4, by time alone)."""
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return runs.select(F.col("w.start").alias("first_at"), F.col("w.end").alias("ends_at"), "event_type", "n")


def sliding_counts(events: DataFrame, length: str = "24 hours", step: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Events by type in overlapping windows, for trends (T-7)."""
    sums = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n")


def streaks(events: DataFrame, good: str = "view", limit: int = 3) -> DataFrame:
    """After each batch, per user: the present run of rows other than `good`, and whether it pauses the user (T-9).

    Rows of a batch count in order of time; the state is one number a user, and a null user is one user.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        fine = batch["event_type"].eq(good).to_numpy()[::-1]
        run = int(fine.argmax()) if fine.any() else run + len(fine)
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]], "run": [run], "paused": [run >= limit]})

    rows = events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id")
    return rows.applyInPandasWithState(advance, "user_id long, run long, paused boolean", "run long", "update", GroupStateTimeout.NoTimeout)


def first_impressions(events: DataFrame, within: str = "1 day") -> DataFrame:
    """Each view that is the first of its user, topic and day (T-10). State goes once the watermark has passed the day."""
    topic, day = F.get_json_object("props", "$.k"), F.date_format("ts", "yyyy-MM-dd")
    views = events.filter("event_type = 'view'").withColumn("topic", topic).withColumn("day", day)
    return views.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "topic", "day"])


def groomed(events: DataFrame, within: str = "1 day") -> DataFrame:
    """A queue of tasks by user and type: the first of each within a day stays, repeats go; urgent types come with a
    priority (T-12)."""
    priority = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_type"]).withColumn("priority", priority)


class Forgetful(StatefulProcessor):
    """Decides on each event of a user in order of time, with one value as the user's state; a timer `hours` after the
    last event forgets the user, so the state is of those who were there of late."""

    schema, column, hours = "", "", 24

    def init(self, handle) -> None:
        self._handle = handle
        self._value = handle.getValueState("value", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state, told = self.decide(batch, self._value.get() if self._value.exists() else None)
        self._value.update(state)
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(at)
        self._handle.registerTimer(int(batch["ts"].iloc[-1].timestamp() * 1000) + self.hours * 3_600_000)
        yield pd.DataFrame({"event_id": batch["event_id"], "user_id": key[0], self.column: told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._value.clear()
        yield pd.DataFrame({"event_id": np.array([], np.int64), "user_id": np.array([], np.int64), self.column: np.array([], bool)})

    def close(self) -> None:
        pass

    def decide(self, batch: pd.DataFrame, state: tuple | None) -> tuple[tuple, list[bool]]:
        raise NotImplementedError


class Limits(Forgetful):
    schema, column = "last string, day string, count long", "allowed"

    def __init__(self, limit: int, seconds: int, daily: int):
        self._limit, self._seconds, self._daily = limit, seconds, daily
        self.hours = max(24, -(-seconds // 3600))

    def decide(self, batch: pd.DataFrame, state: tuple | None) -> tuple[tuple, list[bool]]:
        held, day, count = state or ("", "", 0)
        last, allowed = [int(x) for x in held.split()], []
        for at in batch["ts"]:
            now, today = int(at.value // 1000), str(at.date())
            count = count + 1 if today == day else 1
            day = today
            last = [x for x in last if x > now - self._seconds * 1_000_000]
            allowed.append(len(last) < self._limit and count <= self._daily)
            last = [*last, now][-self._limit :]
        return (" ".join(map(str, last)), day, count), allowed


class Throttle(Forgetful):
    schema, column = "last long, topics string", "sent"

    def __init__(self, gap: int, story_gap: int):
        self._gap, self._story_gap = gap, story_gap
        self.hours = -(-max(gap, story_gap) // 60)

    def decide(self, batch: pd.DataFrame, state: tuple | None) -> tuple[tuple, list[bool]]:
        last, held = state or (-(1 << 60), "{}")
        by_topic, sent = json.loads(held), []
        for row in batch.itertuples():
            now = int(row.ts.value // 60_000_000_000)
            fine = now - last >= self._gap and now - by_topic.get(row.topic, -(1 << 60)) >= self._story_gap
            sent.append(fine)
            if fine:
                last, by_topic[row.topic] = now, now
        return (last, json.dumps({t: at for t, at in by_topic.items() if last - at < self._story_gap})), sent


def rate_limited(events: DataFrame, limit: int = 60, seconds: int = 60, daily: int = 100, late: str = "1 hour") -> DataFrame:
    """Whether each event of a user is let through: less than `limit` tries in the seconds before it, and `daily` tries of
    the day at most; refused tries count too (T-6).

    The state of a user is the last `limit` times and the count of the day, however many events come; it goes a day
    after the last. Needs the RocksDB state store.
    """
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts").groupBy("user_id")
    return rows.transformWithStateInPandas(Limits(limit, seconds, daily), "event_id long, user_id long, allowed boolean", "Append", "EventTime")


def throttled_alerts(events: DataFrame, gap: int = 90, story_gap: int = 180, late: str = "1 hour") -> DataFrame:
    """Purchases as alerts to their user: sent if `gap` minutes have passed since any alert and `story_gap` since one on
    the same topic; throttled ones change no state (T-11). Topics that have waited long enough go from the state, and a
    user who has waited so long goes as a whole. Needs the RocksDB state store."""
    rows = events.withWatermark("ts", late).filter("event_type = 'purchase'")
    rows = rows.select("user_id", "event_id", "ts", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("topic")).groupBy("user_id")
    return rows.transformWithStateInPandas(Throttle(gap, story_gap), "event_id long, user_id long, sent boolean", "Append", "EventTime")


def running_centroids(vectors: DataFrame) -> DataFrame:
    """After each batch, per label: how many vectors have come and their mean; malformed ones and those of another
    length than the label's first are skipped (T-5, A19)."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, [])
        total = np.array(total, float)
        for e in pd.concat(list(frames)).sort_values("vec_id")["embedding"]:
            x = None if e is None else np.array([np.nan if c is None else c for c in e], float)
            if x is None or not len(x) or not np.isfinite(x).all() or (n and len(x) != len(total)):
                continue
            total = total + x if n else x
            n += 1
        state.update((n, total.tolist()))
        yield pd.DataFrame({"label": [key[0]], "n": [n], "mean": [(total / n).tolist() if n else []]})

    rows = vectors.select("label", "vec_id", "embedding").groupBy("label")
    return rows.applyInPandasWithState(advance, "label int, n long, mean array<double>", "n long, total array<double>", "update", GroupStateTimeout.NoTimeout)


def ingest(rows: DataFrame, folder: str, checkpoint: str, seconds: int | None = 600):
    """Starts appending `rows` to Parquet files in `folder`, a batch every `seconds` (T-1), or all that is there (None).

    One query a checkpoint can run at a time: that is the lock of the ingest.
    """
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def published(rows: DataFrame, channel: str, folder: str, checkpoint: str):
    """Starts publishing `rows` as lines of JSON, each with its channel, for those who follow `folder`."""
    message = F.to_json(F.struct(F.lit(channel).alias("channel"), F.struct(*rows.columns).alias("data")))
    return rows.select(message.alias("value")).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
