"""Scalar functions and sinks applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scalars
from tidewire.operators.stories import quantised
from tidewire.sources import sinks


def quiet_titles(docs: DataFrame) -> DataFrame:
    """First lines, the titles, in sentence case where they shout."""
    return docs.select("doc_id", scalars.quiet_title(F.substring_index("text", "\n", 1)).alias("title"))


def turn_overlap(conversations: DataFrame) -> DataFrame:
    """Word overlap of each turn with the turn before it: an equi-join, so long conversations split (F16)."""
    before = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("earlier"))
    pairs = conversations.select("conv_id", "turn", "text").join(before, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", quantised(scalars.overlap(F.col("text"), F.col("earlier"))).alias("overlap"))


def number_counts(docs: DataFrame) -> DataFrame:
    """Numbers in all texts and how often each stands there."""
    return docs.select(F.explode(scalars.numbers(F.col("text"))).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"))


def text_tone(conversations: DataFrame) -> DataFrame:
    """Tone of each turn by a lexicon."""
    return conversations.select("conv_id", "turn", quantised(scalars.tone(F.col("text"))).alias("tone"))


def entry_times(articles: DataFrame) -> DataFrame:
    """Times of articles, the clock where they are out of range."""
    return articles.select("id", scalars.entry_time(F.col("created_at")).alias("at"))


def ad_prices(events: DataFrame) -> DataFrame:
    """Prices in cents."""
    return events.select("event_id", scalars.ad_cents(F.col("value")).alias("cents"))


def _split(articles: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    at = F.lit(day).cast("timestamp_ntz")
    rows = articles.select("id", "created_at", "source", "category", "value")
    return rows.filter(F.col("created_at") < at), rows.filter(F.col("created_at") >= at)


def first_seen(articles: DataFrame, day: str = "2024-01-03") -> DataFrame:
    """What an insert that skips known (source, category) adds from `day` on."""
    return sinks.insert_new(*_split(articles, day), ["source", "category"], ["created_at", "id"])


def current_rows(articles: DataFrame, day: str = "2024-01-15") -> DataFrame:
    """The table by (source, category) after the rows from `day` on are upserted."""
    return sinks.upserted(*_split(articles, day), ["source", "category"], ["created_at", "id"])
