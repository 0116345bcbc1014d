"""Views that give the plain tables the shape of a news store: articles, vectors, sources, tracking events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of every query; none reads the wall clock.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as articles: id, created_at, source, category, cluster_id (the story: props' k and the day), clicks."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("user_id").alias("source"),
        F.col("event_type").alias("category"), F.concat_ws("-", k, F.date_format("ts", "yyyy-MM-dd")).alias("cluster_id"), "value",
    )


ARTICLES_SQL = """(SELECT event_id AS id, ts AS created_at, user_id AS source, event_type AS category,
  concat_ws('-', json_extract_string(props, '$.k'), strftime(ts, '%Y-%m-%d')) AS cluster_id, value FROM events)"""

#: Topics of stories; the first five are hard news.
TOPICS = ("politics", "economy", "crime", "sport", "technology", "life", "fun", "health")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles with words: id, title (the first line), description (the rest), source, category (the
    language), topic, cluster_id (eight doc_ids in a row), created_at (97 minutes apart in a story, within 30 days of
    the clock), clicks, credibility and quality of the source by its number (quality unknown for every fourth)."""
    story, place = F.floor(F.col("doc_id") / 8), F.col("doc_id") % 8
    minutes = ((story * 613 + place * 97) % 43200).cast("int")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), title.alias("title"), F.trim(F.substring("text", F.length(title) + 2, F.lit(1 << 30))).alias("description"), "source",
        F.col("lang").alias("category"), F.element_at(F.array(*map(F.lit, TOPICS)), (story % 8 + 1).cast("int")).alias("topic"),
        F.concat(F.lit("s"), story.cast("string")).alias("cluster_id"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("created_at"), (F.col("doc_id") % 7).alias("clicks"),
        (F.lit(0.4) + F.lit(0.35) * (number % 5)).alias("credibility"), F.when(number % 4 != 3, (number % 4) / 2.0).alias("quality"),
    )


_NUMBER = "regexp_extract(source, '([0-9]+)$', 1)::INTEGER"
NEWS_SQL = f"""(SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, trim(substring(text, length(split_part(text, chr(10), 1)) + 2)) AS description, source, lang AS category,
  [{", ".join(f"'{t}'" for t in TOPICS)}][(doc_id // 8) % 8 + 1] AS topic, 's' || (doc_id // 8)::VARCHAR AS cluster_id,
  TIMESTAMP '{AS_OF}' - to_minutes(((doc_id // 8) * 613 + (doc_id % 8) * 97) % 43200) AS created_at, doc_id % 7 AS clicks,
  0.4::DOUBLE + 0.35::DOUBLE * ({_NUMBER} % 5) AS credibility, CASE WHEN {_NUMBER} % 4 <> 3 THEN ({_NUMBER} % 4) / 2.0::DOUBLE END AS quality FROM documents)"""
