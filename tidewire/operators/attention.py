"""What readers and editors see: breakdowns, engagement, moods, capped lists and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.stories import quantised


def source_breakdown(articles: DataFrame, most: int = 8) -> DataFrame:
    """Per category the `most` sources with most articles, the rest summed as 'other' (A30)."""
    counts = articles.groupBy("category", F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "source"))
    named = F.when(place <= most, F.col("source")).otherwise("other")
    return counts.select("category", named.alias("source"), "n").groupBy("category", "source").agg(F.sum("n").alias("n"))


def navigation(articles: DataFrame) -> DataFrame:
    """Stories by category, each counted once for every source in it."""
    sums = articles.groupBy("category", "source").agg(F.count_distinct("cluster_id").alias("n"))
    return sums.groupBy("category").agg(F.sum("n").alias("stories"))


def engagement(articles: DataFrame) -> DataFrame:
    """Per story, from views, clicks and purchases (standing in for opens): a score of 1.1 at most."""
    of = lambda k: F.count_if(F.col("category") == k)
    sums = articles.groupBy("cluster_id").agg(of("view").alias("views"), of("click").alias("clicks"), of("purchase").alias("opens"))
    by_view = lambda c: F.when(F.col("views") > 0, F.col(c) / F.col("views")).otherwise(0.0)
    score = 1.5 * by_view("clicks") + 0.55 * by_view("opens") + F.least(F.lit(0.25), 0.05 * F.col("clicks"))
    return sums.withColumn("score", quantised(F.least(F.lit(1.1), score)))


def daily_mood(articles: DataFrame) -> DataFrame:
    """Per day the mean value and the most frequent category, ties to the first by name."""
    counts = articles.groupBy(F.to_date("created_at").cast("string").alias("day"), "category").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count("value").alias("known"))
    top = F.min_by("category", F.struct(-F.col("n"), F.col("category")))
    return counts.groupBy("day").agg(quantised(F.sum("total") / F.sum("known"), 4).alias("mean"), top.alias("tone"))


def freshest(articles: DataFrame, most: int = 40) -> DataFrame:
    """The `most` newest articles of each story."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("created_at"), F.desc("id")))
    return articles.select("cluster_id", "id", place.alias("place")).filter(F.col("place") <= most)


def wire_page(articles: DataFrame, cap: int = 2, offset: int = 20, size: int = 20) -> DataFrame:
    """A page of the list by value, with at most `cap` articles a source."""
    order = [F.desc_nulls_last("value"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    capped = articles.withColumn("place", place).filter(F.col("place") <= cap)
    return capped.select("id", "source", "value").orderBy(*order).offset(offset).limit(size)


def followed_stories(articles: DataFrame) -> DataFrame:
    """Stories with a purchase, or with five articles or more, each once."""
    bought = articles.filter("category = 'purchase'").select("cluster_id")
    large = articles.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select("cluster_id")
    return bought.union(large).distinct()
