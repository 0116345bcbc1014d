"""A reader's side: profiles, scores of stories, what to follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.ranking import hours_since, story_scores
from tidewire.operators.stories import quantised

#: Who the reader follows, where a query has no profile of its own.
TOPICS, SOURCES = ("economy",), ("src4", "src11")


def recency(days: Column) -> Column:
    """1, .82, .58, .32, .14 at 2, 7, 14, 30 days; .7 where the time is unknown."""
    return F.when(days.isNull(), 0.7).when(days <= 2, 1.0).when(days <= 7, 0.82).when(days <= 14, 0.58).when(days <= 30, 0.32).otherwise(0.14)


def viewed(news: DataFrame, most: int = 24) -> DataFrame:
    """The stories that a reader has seen last: the newest sport stories, each viewed when its newest article came;
    the view of every third is of unknown time (R42)."""
    rows = news.filter("topic = 'sport'").groupBy("cluster_id").agg(F.max("created_at").alias("at"), F.max("topic").alias("topic"), F.count(F.lit(1)).alias("n"))
    last = rows.orderBy(F.desc("at"), "cluster_id").limit(most)
    number = F.substring("cluster_id", 2, 20).cast("long")
    return last.select("cluster_id", "topic", F.when(number % 3 != 0, hours_since("at") / 24).alias("days"))


def profiles(events: DataFrame) -> DataFrame:
    """Profiles from events: per user the newest 24 stories viewed, one row a story, and at most 12 topics by views."""
    k = F.get_json_object("props", "$.k")
    views = events.filter("event_type = 'view'").select("user_id", k.alias("topic"), F.concat_ws("-", k, F.date_format("ts", "yyyy-MM-dd")).alias("story"), F.col("ts").cast("timestamp_ntz").alias("at"))
    once = views.groupBy("user_id", "story").agg(F.max("at").alias("at"))
    recent = once.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "story"))).filter("place <= 24")
    kept = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("recent"), F.max("at").alias("last_at"), F.min_by("story", "place").alias("last_story"))
    counts = views.groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "topic"))).filter("place <= 12")
    topics = top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "topic"))), lambda x: x["topic"]), ",").alias("topics"))
    return kept.join(topics, "user_id")


def reader_scores(news: DataFrame) -> DataFrame:
    """Stories for a reader, of score over 1.45, seen ones only if there is no other.

    3.2 for a followed topic, min(2.7, .55 + .5 c) for one read with weight c, 2.9 for each followed source, min(1.65,
    .3 + .28 c) for each read, .12 an article beyond the first up to .9, less 1.2 if seen.
    """
    seen = viewed(news)
    weighed = seen.select("cluster_id", "topic", recency(F.col("days")).alias("w"))
    by_topic = weighed.groupBy("topic").agg(F.sum("w").alias("c_topic"))
    by_source = news.select("cluster_id", "source").distinct().join(weighed, "cluster_id").groupBy("source").agg(F.sum("w").alias("c"))
    told = news.select("cluster_id", "source").distinct().join(by_source, "source", "left")
    followed = F.when(F.col("source").isin(*SOURCES), 2.9).otherwise(0.0)
    read = F.coalesce(F.least(F.lit(1.65), 0.3 + 0.28 * F.col("c")), F.lit(0.0))
    of_sources = told.groupBy("cluster_id").agg(F.sum(followed + F.when(F.col("c").isNull(), 0.0).otherwise(read)).alias("of_sources"))
    rows = news.groupBy("cluster_id").agg(F.max("topic").alias("topic"), F.count(F.lit(1)).alias("n")).join(of_sources, "cluster_id").join(by_topic, "topic", "left")
    rows = rows.join(seen.select("cluster_id", F.lit(True).alias("seen")), "cluster_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    of_topic = F.when(F.col("topic").isin(*TOPICS), 3.2).otherwise(0.0) + F.when(F.col("c_topic").isNull(), 0.0).otherwise(F.least(F.lit(2.7), 0.55 + 0.5 * F.col("c_topic")))
    score = of_topic + F.col("of_sources") + F.least(F.lit(0.9), 0.12 * (F.col("n") - 1)) - F.when(F.col("seen"), 1.2).otherwise(0.0)
    kept = rows.select("cluster_id", "seen", quantised(score, 4).alias("score")).filter("score > 1.45")
    unseen = kept.agg(F.count_if(~F.col("seen")).alias("unseen"))  # one row
    return kept.join(F.broadcast(unseen)).filter("not seen or unseen = 0").drop("unseen")


def follow_recommendations(news: DataFrame, least: float = 1.25, most: int = 4) -> DataFrame:
    """Sources and topics to follow: read with a weight of 1.25 or more and not followed yet, heaviest first."""
    weighed = viewed(news).select("cluster_id", "topic", recency(F.col("days")).alias("w"))
    topics = weighed.groupBy(F.col("topic").alias("value")).agg(F.sum("w").alias("c")).filter(~F.col("value").isin(*TOPICS)).withColumn("kind", F.lit("topic"))
    sources = news.select("cluster_id", "source").distinct().join(weighed, "cluster_id").groupBy(F.col("source").alias("value")).agg(F.sum("w").alias("c"))
    sources = sources.filter(~F.col("value").isin(*SOURCES)).withColumn("kind", F.lit("source"))
    rows = topics.unionByName(sources).withColumn("count", quantised(F.col("c"), 3)).filter(F.col("count") >= least)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "value"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("kind", "value", "count", "place")


def digest(news: DataFrame, least: float = 1.9, most: int = 10) -> DataFrame:
    """Stories of a reader's weekly digest: matches of topics and lead source, sources and score; two a topic.

    Match: 2.8 and .4 for a followed topic, 2.4 for a followed lead source, .2 a further source up to 1, .12 of the
    score up to .9; total: match, .2 of the score up to 1.6, .18 for three sources. Engagement is left out.
    """
    from tidewire.operators.ranking import ranked_rows

    lead = ranked_rows(news).filter("rank = 1").select("cluster_id", "topic", F.col("source").alias("lead_source"))
    rows = story_scores(news).join(lead, "cluster_id")
    match = (
        F.when(F.col("topic").isin(*TOPICS), 3.2).otherwise(0.0) + F.when(F.col("lead_source").isin(*SOURCES), 2.4).otherwise(0.0)
        + F.least(F.lit(1.0), 0.2 * (F.col("sources") - 1)) + F.least(F.lit(0.9), 0.12 * F.col("score"))
    )
    total = match + F.least(F.lit(1.6), 0.2 * F.col("score")) + F.when(F.col("sources") >= 3, 0.18).otherwise(0.0)
    rows = rows.select("cluster_id", "topic", quantised(total, 4).alias("total")).filter(F.col("total") >= least)
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("total"), "cluster_id"))
    return rows.withColumn("place", place).filter("place <= 2").orderBy(F.desc("total"), "cluster_id").limit(most).select("cluster_id", "topic", "total")
