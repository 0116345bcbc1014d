"""Text and vector operators over documents and embeddings, in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.gates import feed_link
from tidewire.operators.stories import quantised


def reading_time(docs: DataFrame) -> DataFrame:
    """Minutes at 200 words a minute, 1 at least."""
    words = F.regexp_count("text", F.lit("[^ \t\n\r]+"))
    return docs.select("doc_id", F.greatest(F.lit(1), F.ceil(words / 200)).cast("long").alias("minutes"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links as feeds know them, and hosts in lower case without www (F1, F2)."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1))
    return pages.select("page_id", feed_link(F.col("url")).alias("link"), F.regexp_replace(host, "^www[.]", "").alias("host"))


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label, component by component."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(quantised(F.avg(F.col("x").cast("double"))).alias("mean"))


def text_search(docs: DataFrame, term: str = "the") -> DataFrame:
    """Documents that hold the term, by place: first line starts with it, holds it, or the rest does."""
    title, low = F.lower(F.substring_index("text", "\n", 1)), F.lower("text")
    rank = F.when(title == term, 4).when(title.startswith(term), 3).when(F.contains(title, F.lit(term)), 2).otherwise(1)
    return docs.filter(F.contains(low, F.lit(term))).select("doc_id", rank.cast("long").alias("rank"))


def language_sources(docs: DataFrame) -> DataFrame:
    """Languages by source with their share."""
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") != "en").alias("foreign"))
    return sums.withColumn("share", quantised(100.0 * F.col("foreign") / F.col("n"), 1))
