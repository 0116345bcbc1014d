"""Searches over articles: by words, by vectors, by both; stories like a story; articles for a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.adapters import news, table
from tidewire.operators.index import news_index, ranks
from tidewire.operators.ranking import hours_since, weight
from tidewire.operators.stories import quantised

#: A query of two words, and how many results each branch of a search may give: features of the search.
QUERY, BRANCH = "the and", 300


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors to 4 digits; 0 where one is zero, null or of another length."""
    fine = (F.size(a) == F.size(b)) & (inner(a, a) > 0) & (inner(b, b) > 0)
    return F.coalesce(F.when(fine, quantised(inner(a, b) / F.sqrt(inner(a, a) * inner(b, b)), 4)), F.lit(0.0))


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that have a vector, as `e`."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    return news(spark, sf_dir).join(vectors, "id")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of the smallest vec_id, standing for a query's: one row `q`."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


def match_score(query: str = QUERY) -> Column:
    """4 for the very title, 3 for its beginning, 2 in it, 1 in the description, else 0."""
    title, q = F.lower("title"), query.lower()
    return F.when(title == q, 4).when(title.startswith(q), 3).when(F.contains(title, F.lit(q)), 2).when(F.contains(F.lower("description"), F.lit(q)), 1).otherwise(0)


def word_search(spark: SparkSession, sf_dir: str, query: str = QUERY) -> DataFrame:
    """The 50 best articles with all words of the query: twice the match score plus the rank."""
    rows = news(spark, sf_dir).select("id", "created_at", match_score(query).alias("match")).join(ranks(news_index(spark, sf_dir), query), "id")  # no text is shuffled
    return rows.withColumn("total", quantised(2 * F.col("match") + F.col("rank"))).orderBy(F.desc("total"), F.desc("created_at"), "id").limit(50).select("id", "match", "rank", "total")


def article_search(spark: SparkSession, sf_dir: str, far: float = 0.6, query: str = QUERY) -> DataFrame:
    """Word search plus five times the cosine, of articles that hold the words or lie nearer than `far`."""
    near = table(spark, sf_dir, "embeddings").join(F.broadcast(query_vector(spark, sf_dir)))  # one row
    near = near.select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("near"))
    found = ranks(news_index(spark, sf_dir), query).join(near, "id", "full").filter(F.col("rank").isNotNull() | (1 - F.col("near") < far))
    rows = news(spark, sf_dir).select("id", "created_at", match_score(query).alias("match")).join(found, "id")
    total = quantised(2 * F.col("match") + F.coalesce("rank", F.lit(0.0)) + 5 * F.coalesce("near", F.lit(0.0)))
    return rows.withColumn("total", total).orderBy(F.desc("total"), F.desc("created_at"), "id").limit(50).select("id", "match", "total")


def hybrid_search(spark: SparkSession, sf_dir: str, least: float = 0.1, query: str = QUERY) -> DataFrame:
    """The best article of each story by .45 rank + .55 cosine, from the 300 best of each, less with age."""
    words = ranks(news_index(spark, sf_dir), query).orderBy(F.desc("rank"), "id").limit(BRANCH)
    near = with_vectors(spark, sf_dir).filter(hours_since("created_at") <= 720).join(F.broadcast(query_vector(spark, sf_dir))).select("id", cosine(F.col("e"), F.col("q")).alias("near"))
    near = near.orderBy(F.desc("near"), "id").limit(BRANCH)
    found = words.join(near, "id", "full").filter(F.col("rank").isNotNull() | (F.col("near") > least))  # 2 * BRANCH rows at most
    rows = news(spark, sf_dir).select("id", "cluster_id", "created_at").join(F.broadcast(found), "id")
    base = quantised(0.45 * F.coalesce("rank", F.lit(0.0)) + 0.55 * F.coalesce("near", F.lit(0.0)))
    recency = F.greatest(F.lit(0.1), 1 - hours_since("created_at") / 168)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("base"), "id"))
    best = rows.withColumn("base", base).withColumn("place", place).filter("place = 1")
    return best.select("id", "cluster_id", "base", quantised(F.col("base") * recency).alias("hybrid")).orderBy(F.desc("hybrid"), "id").limit(20)


def semantic_search(spark: SparkSession, sf_dir: str, days: int = 7, most: int = 50) -> DataFrame:
    """Stories of the nearest articles of a week, in order of the cosine of their best-ranked article there."""
    rows = with_vectors(spark, sf_dir).filter(hours_since("created_at") <= 24 * days).withColumn("weight", weight()).join(F.broadcast(query_vector(spark, sf_dir)))
    rows = rows.withColumn("near", cosine(F.col("e"), F.col("q"))).orderBy(F.desc("near"), "id").limit(most)
    lead = F.max_by("near", F.struct("weight", "created_at", -F.col("id")))
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), lead.alias("lead_near"))


def story_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each story and its newest time (A18). Components that are null or not numbers do not count."""
    parts = with_vectors(spark, sf_dir).select("cluster_id", "created_at", F.posexplode("e").alias("i", "x")).filter("not isnan(x)")
    means = parts.groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.max("created_at").alias("newest"))
    rows = means.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("newest").alias("newest"))
    return rows.select("cluster_id", "newest", F.transform("c", lambda c: c["x"]).alias("c"))


def related_stories(spark: SparkSession, sf_dir: str, story: str = "s3", days: int = 14, most: int = 15, least: float = 0.0) -> DataFrame:
    """The stories of 14 days whose mean vector is nearest to a story's."""
    means = story_centroids(spark, sf_dir)
    own = means.filter(F.col("cluster_id") == story).select(F.col("c").alias("q"))
    rows = means.filter((F.col("cluster_id") != story) & (hours_since("newest") <= 24 * days)).join(F.broadcast(own))  # one row
    return rows.select("cluster_id", cosine(F.col("c"), F.col("q")).alias("near")).filter(F.col("near") > least).orderBy(F.desc("near"), "cluster_id").limit(most)


def earlier_stories(spark: SparkSession, sf_dir: str, story: str = "s3", hours: int = 48, most: int = 5, least: float = 0.0) -> DataFrame:
    """The most similar article of each other story before the last 48 hours, best first.

    The list is cut after sorting by similarity, not by story number.
    """
    own = story_centroids(spark, sf_dir).filter(F.col("cluster_id") == story).select(F.col("c").alias("q"))
    rows = with_vectors(spark, sf_dir).filter((F.col("cluster_id") != story) & (hours_since("created_at") > hours)).join(F.broadcast(own))  # one row
    rows = rows.withColumn("near", cosine(F.col("e"), F.col("q"))).filter(F.col("near") > least)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("near"), F.desc("created_at"), "id"))
    return rows.withColumn("place", place).filter("place = 1").orderBy(F.desc("near"), "cluster_id").limit(most).select("cluster_id", "id", "near")


def for_reader(spark: SparkSession, sf_dir: str, recent: int = 10, hours: int = 240, most: int = 10) -> DataFrame:
    """Stories nearest to a reader's interest, the mean of at most ten recent stories, among others of late.

    The reader has seen the newest sport stories.
    """
    means = story_centroids(spark, sf_dir)
    sport = news(spark, sf_dir).filter("topic = 'sport'").select("cluster_id").distinct()
    seen = means.join(sport, "cluster_id", "left_semi").orderBy(F.desc("newest"), "cluster_id").limit(recent)
    parts = seen.select(F.posexplode("c").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    interest = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("q"))  # one row
    rows = means.filter(hours_since("newest") <= hours).join(seen.select("cluster_id"), "cluster_id", "left_anti").join(F.broadcast(interest))
    return rows.select("cluster_id", cosine(F.col("c"), F.col("q")).alias("near")).orderBy(F.desc("near"), "cluster_id").limit(most)


def global_stories(spark: SparkSession, sf_dir: str, headlines: int = 50, least: float = 0.82) -> DataFrame:
    """Whether an article's vector is nearer than `least` to one of the cached headlines, another article's.

    Headlines are the newest articles with a vector, a bounded list.
    """
    rows = with_vectors(spark, sf_dir)
    cached = rows.orderBy(F.desc("created_at"), "id").limit(headlines).select(F.col("id").alias("h"), F.col("e").alias("q"))
    pairs = rows.join(F.broadcast(cached), F.col("id") != F.col("h"))
    best = pairs.groupBy("id").agg(F.max(cosine(F.col("e"), F.col("q"))).alias("nearest"))
    return best.withColumn("global", F.col("nearest") > least)
