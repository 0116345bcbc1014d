"""Scores and labels of stories and sources, and the additive and retention sinks applied to the article view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.adapters import AS_OF
from tidewire.operators.stories import quantised
from tidewire.sources import sinks


def _hours(at: str) -> Column:
    return (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 3.6e9


def weight() -> Column:
    """A source's weight, .4 to 1.8, from its number."""
    return F.lit(0.4) + F.lit(0.35) * (F.col("source") % 5)


def homepage_scores(articles: DataFrame) -> DataFrame:
    """Per story: score for synthesis, for the homepage, and for the feed."""
    sums = articles.groupBy("cluster_id").agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n"), F.count("value").alias("described"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "source"))
    top = articles.select("cluster_id", "source").distinct().withColumn("weight", weight()).withColumn("place", place).filter("place <= 3")
    rows = sums.join(top.groupBy("cluster_id").agg(F.avg("weight").alias("trust")), "cluster_id")
    score = F.col("n_sources") * F.log1p("n")
    synthesis = score * (1 + F.least(F.lit(0.8), 0.28 * F.log1p("n_sources"))) * (1 + F.least(F.lit(0.35), 0.08 * F.col("described")))
    spread = F.when(F.col("n_sources") == 1, 0.65).when(F.col("n_sources") == 2, 1.12).otherwise(1.22)
    home = score * (1 + F.least(F.lit(0.22), F.greatest(F.lit(0.0), 0.16 * (F.col("trust") - 1)))) * spread
    return rows.select("cluster_id", quantised(synthesis, 4).alias("synthesis"), quantised(home, 4).alias("homepage"), quantised(home + 5.0 * F.least("n_sources", F.lit(8)), 4).alias("feed"))


def trust_summary(articles: DataFrame, stale_hours: int = 48) -> DataFrame:
    """Per story: pluralism and trust, 0 to 100, and the tier of trust."""
    sums = articles.groupBy("cluster_id").agg(F.count_distinct("source").alias("s"), F.count_distinct(F.col("source") % 3).alias("t"), F.max("created_at").alias("newest"))
    pluralism = 10 + 15 * F.least("s", F.lit(4)) + 10 * F.greatest(F.col("t") - 1, F.lit(0))
    rows = sums.select("cluster_id", "s", pluralism.cast("long").alias("pluralism"), (_hours("newest") > stale_hours).alias("stale"))
    p = F.col("pluralism")
    trust = 10 * F.least("s", F.lit(8)) + F.when(p <= 15, 25).when(p >= 55, 12).otherwise(18) + F.when(F.col("stale"), 0).otherwise(20)
    tier = F.when(F.col("s") < 2, "early").when(p >= 55, "plural").when(p <= 15, "consensus").otherwise("verified")
    return rows.select("cluster_id", "pluralism", F.least(trust, F.lit(100)).cast("long").alias("trust"), tier.alias("tier"))


def coverage_balance(articles: DataFrame) -> DataFrame:
    """Per story: tiers of its sources, and whether three articles or more come from four sources or two categories."""
    sums = articles.groupBy("cluster_id").agg(
        F.count_distinct(F.col("source") % 3).alias("tiers"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s"), F.count_distinct("category").alias("c")
    )
    label = F.when(F.col("tiers") >= 3, "full").when(F.col("tiers") == 2, "partial")
    return sums.select("cluster_id", label.alias("label"), ((F.col("n") >= 3) & ((F.col("s") >= 4) | (F.col("c") >= 2))).alias("balanced"))


def editorial_signals(articles: DataFrame) -> DataFrame:
    """Per story: freshness by hours since its newest article, and development by sources, 0 to 10."""
    near = F.count_if(_hours("created_at") <= 6)
    sums = articles.groupBy("cluster_id").agg(F.max("created_at").alias("newest"), near.alias("recent"), F.count_distinct("source").alias("s"))
    h = F.greatest(F.lit(0.0), _hours("newest"))
    base = F.when(h <= 12, 10 - 0.45 * h).when(h <= 36, 4.6 - 0.11 * (h - 12)).otherwise(F.greatest(F.lit(0.0), 1.96 - 0.18 * (h - 36)))
    fresh = F.least(F.lit(10.0), base + F.least(F.lit(1.6), 0.45 * F.greatest(F.lit(0), F.col("recent") - 1)))
    grown = F.least(F.lit(10.0), 1.85 * (F.col("s") - 1) + F.least(F.lit(2.0), 0.6 * F.col("recent")))
    return sums.select("cluster_id", quantised(fresh, 4).alias("freshness"), quantised(grown, 4).alias("development"))


def decayed_edges(articles: DataFrame, rate: float = 0.05, least: float = 0.2) -> DataFrame:
    """Edges of source and category: weight less by whole days since last seen, if over one; faint ones go (R14, T-14)."""
    edges = articles.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_seen"))
    days = F.floor(_hours("last_seen") / 24)
    kept = edges.select("source", "category", F.when(days > 1, F.col("n") * F.exp(-rate * days)).otherwise(F.col("n").cast("double")).alias("weight"))
    return kept.filter(F.col("weight") >= least).withColumn("weight", quantised(F.col("weight")))


def copy_purity(docs: DataFrame) -> DataFrame:
    """Whether a text is in Latin script, 24 letters or more and at most 22 % Cyrillic, and how purely."""
    rows = docs.select("doc_id", F.regexp_count("text", F.lit("[A-Za-zÀ-ɏ]")).alias("latin"), F.regexp_count("text", F.lit("[Ѐ-ӿ]")).alias("other"))
    share = F.col("other") / F.greatest(F.col("latin") + F.col("other"), F.lit(1))
    score = 0.45 * F.least(F.lit(1.0), F.col("latin") / 24) + 0.4 * (1 - F.least(F.lit(1.0), share / 0.22)) + 0.15
    return rows.select("doc_id", ((F.col("latin") >= 24) & (share <= 0.22)).alias("ok"), quantised(score, 4).alias("purity"))


def freshness_labels(articles: DataFrame) -> DataFrame:
    """Sources by minutes since their newest article: fresh to 15, aging to 45, else stale."""
    minutes = F.floor(_hours("newest") * 60).cast("long")
    rows = articles.groupBy("source").agg(F.max("created_at").alias("newest")).select("source", minutes.alias("minutes"))
    return rows.withColumn("label", F.when(F.col("minutes") <= 15, "fresh").when(F.col("minutes") <= 45, "aging").otherwise("stale"))


def stance(articles: DataFrame) -> DataFrame:
    """Per story the mean of its values and their population deviation; 0 of one article.

    A billionth is added before rounding to hundredths: halves go up, in whatever order sums were taken.
    """
    sums = articles.groupBy("cluster_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return sums.select("cluster_id", quantised(F.col("m") + 1e-9, 2).alias("mean"), quantised(F.col("d") + 1e-9, 2).alias("divergence"))


def topic_links(articles: DataFrame, most: int = 5) -> DataFrame:
    """For each category the others of its stories: 1.2 a shared story and .26 a source that tells both."""
    told = articles.select("category", "cluster_id", "source").distinct()
    other = told.withColumnRenamed("category", "other")

    def shared(key: str) -> DataFrame:
        both = told.select("category", key).distinct().join(other.select("other", key).distinct(), key).filter("category <> other")
        return both.groupBy("category", "other").agg(F.count(F.lit(1)).alias(f"n_{key}"))

    rows = shared("cluster_id").join(shared("source"), ["category", "other"], "left")
    score = quantised(1.2 * F.col("n_cluster_id") + 0.26 * F.coalesce("n_source", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "other"))
    return rows.select("category", "other", score.alias("score")).withColumn("place", place).filter(F.col("place") <= most)


def reprocessing(articles: DataFrame, floor: float = 20.0, budget: int = 50) -> DataFrame:
    """The stories to work on again first: poor, of a week, or of three days with two articles."""
    sums = articles.groupBy("cluster_id").agg(F.min("value").alias("quality"), F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    due = ((F.col("quality") < floor) & (_hours("newest") <= 168)) | ((_hours("newest") <= 72) & (F.col("n") >= 2))
    return sums.filter(due).orderBy(F.asc_nulls_last("quality"), F.desc("n"), F.desc("newest"), "cluster_id").limit(budget).select("cluster_id", "quality", "n")


def weights_after(articles: DataFrame, day: str = "2024-01-15") -> DataFrame:
    """Weights of (source, category) once the rows from `day` on are added to those before."""
    at = F.lit(day).cast("timestamp_ntz")
    sums = lambda rows: rows.groupBy("source", "category").agg(F.count(F.lit(1)).alias("weight"), F.max("created_at").alias("last_seen"))
    old, new = articles.filter(F.col("created_at") < at), articles.filter(F.col("created_at") >= at)
    return sinks.added(sums(old), sums(new), ["source", "category"], ["weight"], ["last_seen"])


def retained(articles: DataFrame, days: int = 20) -> DataFrame:
    """Sources whose rows all go by age: the orphans of a retention by `days`."""
    kept = articles.filter(_hours("created_at") <= 24 * days).select("source")
    return articles.join(kept, "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("gone"))
