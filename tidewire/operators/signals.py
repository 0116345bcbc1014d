"""Streaks, staleness, moving statistics, search by vector and small text signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.adapters import AS_OF
from tidewire.operators.stories import quantised


def staleness(articles: DataFrame) -> DataFrame:
    """Per category: stories, and those whose newest article is older than two days of the clock."""
    newest = articles.groupBy("category", "cluster_id").agg(F.max("created_at").alias("newest"))
    old = F.col("newest") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 2 days")
    return newest.groupBy("category").agg(F.count(F.lit(1)).alias("stories"), F.count_if(old).alias("stale"))


def moving_stats(articles: DataFrame, last: int = 100) -> DataFrame:
    """Number and maximum of the last `last` values of each source, at every article."""
    window = Window.partitionBy("source").orderBy("created_at", "id").rowsBetween(1 - last, 0)
    return articles.select("id", "source", F.count(F.lit(1)).over(window).alias("n"), F.max("value").over(window).alias("highest"))


def recency_weight(articles: DataFrame) -> DataFrame:
    """Step weight by age in days: 1, .82, .58, .32, .14 at 2, 7, 14, 30; .7 of unknown time (F35). Every tenth
    article's time is taken as unknown."""
    days = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 8.64e10
    days = F.when(F.col("id") % 10 != 0, days)
    steps = F.when(days.isNull(), 0.7).when(days <= 2, 1.0).when(days <= 7, 0.82).when(days <= 14, 0.58).when(days <= 30, 0.32).otherwise(0.14)
    return articles.select("id", steps.alias("weight"))


def nearest_days(articles: DataFrame, day: str = "2024-01-15") -> DataFrame:
    """The last day with articles before `day` and the first after it (O3)."""
    at = F.to_date("created_at")
    pivot = F.lit(day).cast("date")
    return articles.agg(F.max(F.when(at < pivot, at)).cast("string").alias("before"), F.min(F.when(at > pivot, at)).cast("string").alias("after"))


def key_counts(events: DataFrame) -> DataFrame:
    """Events by the number in their JSON properties; what is not a number counts as null."""
    return events.groupBy(F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def event_counters(events: DataFrame) -> DataFrame:
    """Counter per day, event and properties."""
    return events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type", "props").agg(F.count(F.lit(1)).alias("n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Lower-case text whose runs of other than letters and digits are one space, as MD5."""
    return docs.select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))).alias("mark"))


def similar_to_first(vectors: DataFrame, k: int = 15) -> DataFrame:
    """The k vectors of largest cosine to the one with the smallest id."""
    first = vectors.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    near = vectors.join(F.broadcast(first), F.col("vec_id") != F.col("q"))  # one row
    cosine = dot("embedding", "e") / F.sqrt(dot("embedding", "embedding") * dot("e", "e"))
    return near.select("vec_id", quantised(cosine, 4).alias("cosine"), cosine.alias("c")).orderBy(F.desc("c"), "vec_id").limit(k).drop("c")


def turns(conversations: DataFrame) -> DataFrame:
    """Turns of each conversation, by role, and its longest text."""
    of = lambda r: F.count_if(F.col("role") == r)
    return conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), of("user").alias("asked"), of("assistant").alias("answered"), F.max(F.length("text")).cast("long").alias("longest"))


def visitor_hash(events: DataFrame, salt: str = "s") -> DataFrame:
    """SHA-256 of user, day and salt (F32), with its events."""
    mark = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.lit(salt)), 256)
    return events.groupBy(mark.alias("visitor")).agg(F.count(F.lit(1)).alias("n"))
