"""Feeds as files: whole XML documents repaired and taken apart into items; which sources are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.gates import feed_link, repaired_xml

ITEM = "title string, link string, description string, pubDate string, published string"


def feed_items(spark: SparkSession, folder: str, most: int = 100) -> DataFrame:
    """The first `most` items of each feed in a folder: feed, place, title, link, description, published.

    Fetching stays outside: feeds are landed files. Broken XML is repaired first; an item that stays broken has nulls.
    """
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.xml").select(F.col("_metadata.file_name").alias("feed"), repaired_xml(F.col("value")).alias("xml"))
    items = F.slice(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0)), 1, most)
    rows = whole.select("feed", F.posexplode(items).alias("place", "item"))
    tag = F.regexp_extract("item", r"<(item|entry)\b", 1)
    plain = F.regexp_replace(F.regexp_replace("item", r"<(/?)[a-z]+:([a-zA-Z]+)", "<$1$2"), r"^<(?:item|entry)\b[^>]*>", "<item>")
    plain = F.regexp_replace(plain, r"</(?:item|entry)>$", "</item>")
    parsed = rows.select("feed", "place", tag.alias("kind"), F.from_xml(plain, ITEM, {"rowTag": "item"}).alias("x"))
    link = F.when(F.col("x.link").isNotNull(), feed_link(F.col("x.link")))
    return parsed.select("feed", "place", F.trim("x.title").alias("title"), link.alias("link"), F.trim("x.description").alias("description"), F.coalesce("x.pubDate", "x.published").alias("published"))


def active_sources(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Feeds to read: those that are active and whose source is (S3)."""
    named = sources.filter("is_active").select(F.col("name").alias("source_name"), "credibility")
    return feeds.filter("is_active").join(named, F.col("name") == F.col("source_name")).select("name", "url", "credibility")
