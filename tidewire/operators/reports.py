"""Editors' reports: viewpoints, samples, mixes, adoption, alerts, clustering quality, graph repair, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.adapters import AS_OF
from tidewire.operators.stories import quantised


def _since(hours: int) -> Column:
    at = F.col("created_at")
    now = F.lit(AS_OF).cast("timestamp_ntz")
    return (at >= now - F.expr(f"interval {hours} hours")) & (at < now)


def _ratio(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return quantised(a / F.nullif(b, F.lit(0)))


def viewpoint_tiers(articles: DataFrame) -> DataFrame:
    """Stories by day that sources of one, two and three tiers tell (A11); the tier is the source's number modulo 3."""
    told = articles.groupBy("cluster_id").agg(F.count_distinct(F.col("source") % 3).alias("tiers"), F.min(F.to_date("created_at")).cast("string").alias("day"))
    of = lambda n: F.count_if(F.col("tiers") == n)
    sums = told.groupBy("day").agg(F.count(F.lit(1)).alias("stories"), of(3).alias("full"), of(2).alias("partial"))
    return sums.withColumn("share", _ratio(100.0 * F.col("full"), F.col("stories")))


def story_text(articles: DataFrame) -> DataFrame:
    """The categories of each story's articles in order of time, joined."""
    members = F.array_sort(F.collect_list(F.struct("created_at", "id", "category")))
    return articles.groupBy("cluster_id").agg(F.array_join(F.transform(members, lambda m: m["category"]), ", ").alias("words"))


def top_sample(articles: DataFrame, most: int = 8) -> DataFrame:
    """The sources with most articles in each category, as a JSON list."""
    counts = articles.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "source"))
    few = counts.withColumn("place", place).filter(F.col("place") <= most)
    rows = F.array_sort(F.collect_list(F.struct("place", "source", "n")))
    return few.groupBy("category").agg(F.to_json(F.transform(rows, lambda r: F.struct(r["source"].alias("source"), r["n"].alias("n")))).alias("sample"))


def running_centroid_vector(vectors: DataFrame) -> DataFrame:
    """The mean vector of each label as vectors arrive, a row for each component (A19, T-5)."""
    parts = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    so_far = Window.partitionBy("label", "i").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("x").cast("double")
    return parts.select("vec_id", "label", "i", F.count(x).over(so_far).alias("n"), quantised(F.avg(x).over(so_far), 4).alias("mean"))


def provider_mix(articles: DataFrame, fallback: str = "purchase") -> DataFrame:
    """Per source the share of `fallback` rows in the last day and week, and its rise."""
    of = lambda h: (F.count_if(_since(h) & (F.col("category") == fallback)), F.count_if(_since(h)))
    sums = articles.groupBy("source").agg(_ratio(*of(24)).alias("day"), _ratio(*of(168)).alias("week"))
    return sums.withColumn("rise", quantised(F.coalesce("day", F.lit(0.0)) - F.coalesce("week", F.lit(0.0))))


def adoption(articles: DataFrame) -> DataFrame:
    """Sources by the length of their JSON list of categories."""
    lists = articles.groupBy("source").agg(F.to_json(F.array_sort(F.collect_set("category"))).alias("kinds"))
    return lists.groupBy(F.json_array_length("kinds").cast("long").alias("kinds")).agg(F.count(F.lit(1)).alias("sources"))


def alert_engagement(articles: DataFrame, least: int = 3) -> DataFrame:
    """Per source and day with `least` views or more: clicks and purchases a view."""
    of = lambda k: F.count_if(F.col("category") == k)
    keys = ["source", F.to_date("created_at").cast("string").alias("day")]
    sums = articles.groupBy(*keys).agg(of("view").alias("sent"), of("click").alias("opened"), of("purchase").alias("saved")).filter(F.col("sent") >= least)
    return sums.select("*", _ratio(F.col("opened"), F.col("sent")).alias("open_rate"), _ratio(F.col("saved"), F.col("sent")).alias("save_rate"))


def clustering_quality(assigned: DataFrame) -> DataFrame:
    """Precision, recall and F1 over pairs of rows (label, found), from the contingency table."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = assigned.groupBy("label", "found").agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(pairs("n").alias("tp"))
    found = cells.groupBy("found").agg(F.sum("n").alias("n")).agg(pairs("n").alias("p"))
    gold = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(pairs("n").alias("g"))
    one = both.crossJoin(found).crossJoin(gold)  # one row each
    out = one.select(F.col("tp").cast("long").alias("tp"), (F.col("p") - F.col("tp")).cast("long").alias("fp"), (F.col("g") - F.col("tp")).cast("long").alias("fn"))
    return out.select("*", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def vector_clusters(vectors: DataFrame) -> DataFrame:
    """Labels beside a cluster by the largest component."""
    return vectors.select("label", F.array_position("embedding", F.array_max("embedding")).alias("found"))


def window_quality(articles: DataFrame, hours: int = 24) -> DataFrame:
    """Per category: groups, those longer than `hours`, those of one source (A32, without vectors)."""
    group = F.substring_index("cluster_id", "-", 1).alias("k")
    sums = articles.groupBy("category", group).agg(F.min("created_at").alias("a"), F.max("created_at").alias("z"), F.count_distinct("source").alias("n_sources"))
    long = F.col("z") > F.col("a") + F.expr(f"interval {hours} hours")
    out = sums.groupBy("category").agg(F.count(F.lit(1)).alias("groups"), F.count_if(long).alias("spanning"), F.count_if(F.col("n_sources") == 1).alias("single"))
    return out.withColumn("single_share", _ratio(100.0 * F.col("single"), F.col("groups")))


def merged_nodes(articles: DataFrame) -> DataFrame:
    """Nodes merged by source: mentions summed, tone weighted by mentions, the type most mentioned."""
    nodes = articles.groupBy("source", "category").agg(F.count(F.lit(1)).alias("mentions"), F.avg("value").alias("tone"))
    tone = F.sum(F.col("tone") * F.col("mentions")) / F.sum(F.when(F.col("tone").isNotNull(), F.col("mentions")))
    kind = F.min_by("category", F.struct(-F.col("mentions"), F.col("category")))
    return nodes.groupBy("source").agg(F.sum("mentions").alias("mentions"), quantised(tone, 4).alias("tone"), kind.alias("kind"))


def trending(articles: DataFrame, least: int = 2) -> DataFrame:
    """Topics of the last day against their daily mean of the week before (R15, T-7): ratio to the mean plus one."""
    topic = F.substring_index("cluster_id", "-", 1).alias("topic")
    sums = articles.filter(_since(192)).groupBy(topic).agg(F.count_if(_since(24)).alias("now"), F.count_if(~_since(24)).alias("before"))
    return sums.filter(F.col("now") >= least).withColumn("burst", quantised(F.col("now") / (F.col("before") / 7.0 + 1.0)))


def story_sessions(articles: DataFrame, gap: int = 24) -> DataFrame:
    """Runs of a topic's articles without a pause of more than `gap` hours (T-4, by time alone)."""
    topic = F.substring_index("cluster_id", "-", 1)
    order = Window.partitionBy("topic").orderBy("created_at", "id")
    rows = articles.select(topic.alias("topic"), "created_at", "id")
    opens = F.col("created_at") > F.lag("created_at").over(order) + F.expr(f"interval {gap} hours")
    runs = rows.withColumn("opens", opens).withColumn("run", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("topic", "run").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def first_impressions(articles: DataFrame) -> DataFrame:
    """Per day: views, and those that are the first of their source and topic that day (T-10)."""
    seen = articles.filter("category = 'view'").groupBy(F.to_date("created_at").cast("string").alias("day"), "source", F.substring_index("cluster_id", "-", 1).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("day").agg(F.sum("n").alias("views"), F.count(F.lit(1)).alias("counted"))


def groomed_queue(articles: DataFrame) -> DataFrame:
    """The oldest row of each story and category, repeats counted (T-12)."""
    return articles.groupBy("cluster_id", "category").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), (F.count(F.lit(1)) - 1).alias("repeats"))


def error_streaks(articles: DataFrame, streak: int = 3) -> DataFrame:
    """Per source the longest run of rows other than views, and whether it pauses the source (T-9)."""
    order = Window.partitionBy("source").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    good = F.sum(F.when(F.col("category") == "view", 1).otherwise(0)).over(order)
    runs = articles.select("source", "category", good.alias("run")).filter("category <> 'view'").groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("source").agg(F.max("n").alias("longest"), (F.max("n") >= streak).alias("paused"))


def day_articles(articles: DataFrame, day: str = "2024-01-15") -> DataFrame:
    """Articles from `day` on and before the next."""
    at, start = F.col("created_at"), F.lit(day).cast("timestamp_ntz")
    return articles.filter((at >= start) & (at < start + F.expr("interval 1 day"))).select("id", "source", "category")
