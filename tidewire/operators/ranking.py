"""Sources and stories ranked: weights, scores, roles, balance, freshness of summaries, reputations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.adapters import AS_OF
from tidewire.functions.scalars import long_words, numbers, overlap, words_overlap
from tidewire.operators.stories import quantised

#: Articles of a story that another of it is compared with.
MOST_MEMBERS = 40
HARD_TOPICS, SOFT_TOPICS = ("politics", "economy", "crime", "sport", "technology"), ("life", "fun", "health")


def hours_since(at: str) -> Column:
    return (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 3.6e9


def weight() -> Column:
    """Credibility times the quality of the source, .45 to 1.05; 1 where the quality is unknown."""
    by_quality = F.greatest(F.lit(0.45), F.least(F.lit(1.05), F.lit(0.55) + F.col("quality") * 0.5))
    return F.col("credibility") * F.when(F.col("quality").isNull(), 1.0).otherwise(by_quality)  # greatest() skips nulls


def tier(weight: Column) -> Column:
    return F.when(weight >= 1.75, "high").when(weight >= 1.3, "confirmed").otherwise("followed")


def source_weights(news: DataFrame) -> DataFrame:
    """Each source's weight and tier of trust."""
    rows = news.select("source", weight().alias("w")).distinct()
    return rows.select("source", quantised(F.col("w")).alias("weight"), tier(F.col("w")).alias("tier"))


def ranked_rows(news: DataFrame) -> DataFrame:
    """Articles with their weight and their rank in the story: by weight, time, id. A story's rows are few."""
    rows = news.withColumn("weight", weight())
    order = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), F.desc("created_at"), "id")
    return rows.withColumn("rank", F.row_number().over(order))


def ranked_in_story(news: DataFrame) -> DataFrame:
    """Articles ranked in their story, those whose title nearly repeats a better one's last.

    Greedy, so a story at a time: taken by weight and .12 for a description, an article is redundant if its title
    overlaps a kept one by .85 or more; then by weight, less 5 if redundant, and time. Ties go by id.
    """
    first = weight() + F.when(F.length(F.trim("description")) > 0, 0.12).otherwise(0.0)
    rows = news.select("id", "cluster_id", "title", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), weight().alias("weight"), first.alias("first"))
    dealt = rows.repartition("cluster_id").sortWithinPartitions("cluster_id", F.desc("first"), "id")
    return dealt.mapInArrow(_ranked, "id long, cluster_id string, redundant boolean, rank int")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the stories of a partition, whose rows come one story after another, best first."""
    story, held = (), []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("cluster_id", "id", "title", "at", "weight")), strict=True):
            if held and row[0] != story:
                out += _ranks(held)
                held = []
            story = row[0]
            held.append(row)
        yield _rank_rows(out)
    yield _rank_rows(_ranks(held))


def _ranks(rows: list[tuple]) -> list[tuple]:
    kept: list[set[str]] = []
    told = []
    for story, key, title, at, held in rows:
        own = {w for w in (title or "").lower().split() if len(w) >= 4}
        near = any(len(own & k) / (len(own | k) or 1) >= 0.85 for k in kept)
        if not near:
            kept.append(own)
        told.append((held - 5.0 * near, at, -key, story, near))
    told.sort(key=lambda r: r[:3], reverse=True)
    return [(-minus, story, near, i + 1) for i, (_, _, minus, story, near) in enumerate(told)]


def _rank_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.bool_(), pa.int32())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["id", "cluster_id", "redundant", "rank"])


def story_scores(news: DataFrame) -> DataFrame:
    """Per story: score, and scores for synthesis, homepage and feed.

    Score: weights of the distinct sources, times e^(-.115 h) of the first row in rank order, times log of the size,
    times 1 + .15 log of the clicks.
    """
    rows = ranked_rows(news)
    first = F.col("rank") == 1
    sums = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("clicks").alias("clicks"), F.count_distinct("source").alias("sources"), F.max(F.when(first, hours_since("created_at"))).alias("hours"),
        F.count_if(F.length(F.trim("description")) > 0).alias("described"), F.avg(F.when(F.col("rank") <= 3, F.col("weight"))).alias("trust"),
    )
    trusted = rows.select("cluster_id", "source", "weight").distinct().groupBy("cluster_id").agg(F.sum("weight").alias("held"))
    rows = sums.join(trusted, "cluster_id")
    score = F.col("held") * F.exp(-0.115 * F.col("hours")) * F.log1p("n") * (1 + 0.15 * F.log1p("clicks"))
    synthesis = F.col("score") * (1 + F.least(F.lit(0.8), 0.28 * F.log1p("sources"))) * (1 + F.least(F.lit(0.35), 0.08 * F.col("described")))
    spread = F.when(F.col("sources") <= 1, 0.65).when(F.col("sources") == 2, 1.12).otherwise(1.22)
    home = F.col("score") * (1 + F.greatest(F.lit(0.0), F.least(F.lit(0.22), 0.16 * (F.col("trust") - 1)))) * spread
    rows = rows.withColumn("score", score).withColumn("synthesis", synthesis).withColumn("homepage", home).withColumn("feed", F.col("homepage") + 5.0 * F.least("sources", F.lit(8)))
    return rows.select("cluster_id", "n", "sources", *[quantised(F.col(c), 5).alias(c) for c in ("score", "synthesis", "homepage", "feed")])


def source_roles(news: DataFrame) -> DataFrame:
    """What each article does in its story: confirm, lead, contrast or context, and how many titles corroborate it (R26), of
    the MOST_MEMBERS best-ranked ones; a story of the online rule has no more."""
    rows = ranked_rows(news).select("cluster_id", "id", long_words(F.col("title")).alias("words"), "created_at", "weight", "rank")
    other = rows.filter(F.col("rank") <= MOST_MEMBERS).select("cluster_id", F.col("id").alias("o"), F.col("words").alias("o_words"))
    pairs = rows.select("cluster_id", "id", "words").join(other, "cluster_id").filter("id <> o")
    near = pairs.groupBy("id").agg(F.count_if(words_overlap(F.col("words"), F.col("o_words")) >= 0.3).alias("corroborated"))
    lead = rows.filter("rank = 1").select("cluster_id", F.col("words").alias("lead_words"), F.col("created_at").alias("lead_at"))
    first = rows.groupBy("cluster_id").agg(F.min("created_at").alias("first_at"))
    every = rows.join(lead, "cluster_id").join(first, "cluster_id").join(near, "id", "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(0)))
    like = F.when(F.col("rank") == 1, 1.0).otherwise(words_overlap(F.col("words"), F.col("lead_words")))
    late = F.col("created_at") > F.col("lead_at") + F.expr("interval 90 minutes")
    role = (
        F.when((F.col("rank") == 1) & (F.col("corroborated") >= 2), "confirm").when((F.col("rank") == 1) & (F.col("weight") >= 1.6), "lead")
        .when((F.col("created_at") <= F.col("first_at")) & (F.col("weight") >= 1.3), "lead").when(like < 0.22, "contrast").when(late, "context")
        .when(like >= 0.4, "confirm").otherwise("context")
    )
    return every.select("id", "cluster_id", "corroborated", role.alias("role"))


def coverage(news: DataFrame) -> DataFrame:
    """Per article its relation to the story's lead; per story the tiers of its sources and whether it is balanced."""
    rows = ranked_rows(news)
    kind = F.when(F.col("weight") >= 1.3, "M").when(F.col("weight") >= 0.9, "I").otherwise("R")
    sums = rows.groupBy("cluster_id").agg(
        F.count_distinct(kind).alias("tiers"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s"), F.count_distinct("category").alias("c"), F.max(F.when(F.col("rank") == 1, F.col("title"))).alias("lead")
    )
    label = F.when(F.col("tiers") >= 3, "full").when(F.col("tiers") == 2, "partial")
    balanced = (F.col("n") >= 3) & ((F.col("s") >= 4) | (F.col("c") >= 2))
    like = F.when(F.col("rank") == 1, 1.0).otherwise(overlap(F.col("title"), F.col("lead")))
    relation = F.when(F.col("rank") == 1, "lead").when(like >= 0.45, "same").when(like >= 0.2, "related").otherwise("context")
    return rows.join(sums.select("cluster_id", label.alias("label"), balanced.alias("balanced"), "lead"), "cluster_id").select("id", "cluster_id", "label", "balanced", relation.alias("relation"))


def summary_freshness(news: DataFrame) -> DataFrame:
    """Whether a story's summary is due (R30). The summary stands at the story's middle article by time; stories whose
    number ends in 3 have none. Newer articles add to the score by sources, numbers, angle, weight and balance."""
    order = Window.partitionBy("cluster_id").orderBy("created_at", "id")
    whole = Window.partitionBy("cluster_id")
    rows = news.withColumn("weight", weight()).withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(whole))
    middle = F.floor((F.col("n") + 1) / 2)
    rows = rows.withColumn("summary_at", F.when(~F.col("cluster_id").endswith("3"), F.max(F.when(F.col("place") == middle, F.col("created_at"))).over(whole)))
    newer = F.col("created_at") > F.col("summary_at")
    told = F.concat_ws(" ", "title", "description")
    sums = rows.groupBy("cluster_id", "summary_at").agg(
        F.count_if(newer).alias("newer"), F.collect_set(F.when(newer, F.col("source"))).alias("new_sources"), F.collect_set(F.when(~newer, F.col("source"))).alias("old_sources"),
        F.flatten(F.collect_set(F.when(newer, F.array_distinct(numbers(told))))).alias("new_numbers"), F.flatten(F.collect_set(F.when(~newer, F.array_distinct(numbers(told))))).alias("old_numbers"),
        F.min_by("title", F.when(newer, F.struct("created_at", "id"))).alias("new_title"), F.min_by("title", F.when(~newer, F.struct("created_at", "id"))).alias("old_title"),
        F.max(F.when(newer, F.col("weight"))).alias("best"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s"), F.count_distinct("category").alias("c"),
        F.count_distinct(F.when(~newer, F.col("category"))).alias("old_c"),
    )
    added = F.size(F.array_except("new_sources", "old_sources"))
    balanced = lambda n, s, c: (n >= 3) & ((s >= 4) | (c >= 2))
    becomes = balanced(F.col("n"), F.col("s"), F.col("c")) & ~balanced(F.col("n") - F.col("newer"), F.size("old_sources"), F.col("old_c"))
    some = F.col("newer") > 0
    score = (
        F.when(added > 0, F.least(F.lit(2.0), 1 + 0.4 * added)).otherwise(0.0) + F.when(F.size(F.array_except("new_numbers", "old_numbers")) > 0, 1.1).otherwise(0.0)
        + F.when(some & (overlap(F.col("new_title"), F.col("old_title")) < 0.26), 0.9).otherwise(0.0) + F.when(F.col("newer") >= 2, 0.5).otherwise(0.0)
        + F.when(F.col("best") >= 1.45, 0.65).otherwise(0.0) + F.when(some & becomes, 1.2).otherwise(0.0)
    )
    scored = sums.select("cluster_id", "summary_at", "newer", added.alias("added"), score.alias("score"), (hours_since("summary_at") * 60).alias("minutes"))
    waits = F.col("minutes") < F.when(F.col("score") >= 4, 20).otherwise(40)
    due = ((F.col("score") >= 2) | (F.col("newer") >= 4)) & ~(waits & (F.col("newer") < 2) & (F.col("added") == 0))
    reason = F.when(F.col("summary_at").isNull(), "missing").when(due, "stale").otherwise("fresh")
    return scored.select("cluster_id", "newer", quantised(F.when(F.col("summary_at").isNotNull(), F.col("score")).otherwise(0.0), 3).alias("score"), (F.col("summary_at").isNull() | due).alias("refresh"), reason.alias("reason"))


def editor_signals(news: DataFrame) -> DataFrame:
    """Per story: freshness, development, trust, importance, novelty, state, and the scores of live and wire."""
    rows = ranked_rows(news)
    sums = rows.groupBy("cluster_id").agg(
        F.max("created_at").alias("newest"), F.count_if(hours_since("created_at") <= 6).alias("recent"), F.count_distinct("source").alias("s"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("rank") <= 3, F.col("weight"))).alias("trusted"), F.max(F.when(F.col("rank") == 1, F.col("topic"))).alias("topic"),
    )
    rows = sums.join(story_scores(news).select("cluster_id", "score", "homepage"), "cluster_id").withColumn("h", F.greatest(F.lit(0.0), hours_since("newest")))
    h, cap = F.col("h"), lambda x: F.least(F.lit(10.0), x)
    base = F.when(h <= 12, 10 - 0.45 * h).when(h <= 36, 4.6 - 0.11 * (h - 12)).otherwise(F.greatest(F.lit(0.0), 1.96 - 0.18 * (h - 36)))
    rows = rows.withColumn("freshness", cap(base + F.least(F.lit(1.6), 0.45 * F.greatest(F.lit(0), F.col("recent") - 1))))
    rows = rows.withColumn("development", cap(1.85 * (F.col("s") - 1) + F.least(F.lit(2.0), 0.6 * F.col("recent"))))
    rows = rows.withColumn("trust", cap(5 * F.col("trusted"))).withColumn("importance", cap(3 * F.col("homepage")))
    rows = rows.withColumn("novelty", cap(F.col("freshness") * F.when(F.col("s") <= 2, 1.0).otherwise(0.65) + F.when(F.col("n") == 1, 1.25).otherwise(0.0)))
    state = (
        F.when(h >= 36, "stale").when(F.col("score") >= 4.5, "breaking").when((F.col("s") >= 3) & (F.col("recent") >= 2), "developing")
        .when(F.col("s") >= 2, "confirmed").otherwise("singleton")
    )
    rows = rows.withColumn("state", state).withColumn("hard", F.when(F.col("topic").isin(*HARD_TOPICS), 1.0).otherwise(0.0))
    live = F.col("freshness") + F.col("development") + F.when(F.col("state") == "breaking", 2.5).otherwise(0.0) + 1.2 * F.col("hard")
    wire = F.col("freshness") + F.col("novelty") + F.when(F.col("s") <= 1, 1.0).otherwise(0.0) + F.col("hard")
    scores = [quantised(F.col(c), 4).alias(c) for c in ("freshness", "development", "trust", "importance", "novelty")]
    return rows.select("cluster_id", *scores, "state", quantised(live, 4).alias("live"), quantised(wire, 4).alias("wire"))


def lead_story(news: DataFrame, among: int = 4) -> DataFrame:
    """The first of the `among` best stories of the homepage that has two sources, else the best."""
    best = story_scores(news).orderBy(F.desc("homepage"), "cluster_id").limit(among)
    return best.orderBy(F.when(F.col("sources") >= 2, 0).otherwise(1), F.desc("homepage"), "cluster_id").limit(1).select("cluster_id", "sources", "homepage")


def source_reputation(news: DataFrame) -> DataFrame:
    """Per source: weight and tier, shares of corroborated and lone leads of 30 days, trend, first mover, top categories."""
    at = F.col("created_at")
    back = lambda d: F.lit(AS_OF).cast("timestamp_ntz") - F.expr(f"interval {d} days")
    rows = news.withColumn("weight", weight())
    story = rows.filter(at >= back(30)).groupBy("cluster_id").agg(F.min_by("source", F.struct("created_at", "id")).alias("source"), F.count_distinct("source").alias("s"))
    leads = story.groupBy("source").agg(F.count(F.lit(1)).alias("firsts"), F.count_if(F.col("s") >= 2).alias("backed"), F.count_if(F.col("s") == 1).alias("alone"))
    sums = rows.groupBy("source").agg(
        F.max("weight").alias("w"), F.count(F.lit(1)).alias("volume"), F.count_if(at >= back(7)).alias("week"), F.count_if((at >= back(14)) & (at < back(7))).alias("before")
    )
    kinds = rows.groupBy("source", "category").agg(F.count(F.lit(1)).alias("k"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("k"), "category"))
    top = kinds.withColumn("place", place).filter("place <= 3").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "category"))), lambda x: x["category"]), ",").alias("top"))
    every = sums.join(top, "source").join(leads, "source", "left").fillna(0, ["firsts", "backed", "alone"])
    share = lambda c: F.when(F.col("firsts") > 0, quantised(F.col(c) / F.col("firsts"), 2)).otherwise(0.0)
    change = F.col("week") - F.col("before")
    return every.select(
        "source", quantised(F.col("w")).alias("weight"), tier(F.col("w")).alias("tier"), "volume", "firsts", share("backed").alias("corroboration"), share("alone").alias("solo"),
        F.when(change >= 4, "up").when(change <= -4, "down").otherwise("flat").alias("trend"), (F.col("firsts") >= 5).alias("first_mover"), "top",
    )
