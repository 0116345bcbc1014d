"""Story and source analytics over the article view: aggregates, first movers, funnels, facets, time series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.adapters import AS_OF
from tidewire.tables import written


def _now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def quantised(x: Column, digits: int = 6) -> Column:
    scale = float(10**digits)
    return (F.floor(x * scale + 0.5) / scale).cast("double")


def source_history(articles: DataFrame) -> DataFrame:
    """Per source: stories it opened, those with two sources or more, those alone, and articles of two weeks."""
    story = articles.groupBy("cluster_id").agg(
        F.min_by("source", F.struct("created_at", "id")).alias("source"), F.count_distinct("source").alias("n_sources")
    )
    leads = story.groupBy("source").agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(F.col("n_sources") >= 2).alias("corroborated"), F.count_if(F.col("n_sources") == 1).alias("solo")
    )
    week = lambda a, b: F.count_if((F.col("created_at") >= _now() - F.expr(f"interval {a} days")) & (F.col("created_at") < _now() - F.expr(f"interval {b} days")))
    recent = articles.groupBy("source").agg(F.count(F.lit(1)).alias("articles"), week(7, 0).alias("week"), week(14, 7).alias("week_before"))
    out = recent.join(leads, "source", "left")
    return out.select("source", "articles", "week", "week_before", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("leads", "corroborated", "solo")])


def heatmap(articles: DataFrame) -> DataFrame:
    """Per day: stories, and stories of five articles or more (A2)."""
    daily = articles.groupBy(F.to_date("created_at").cast("string").alias("day"), "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("day").agg(F.count(F.lit(1)).alias("stories"), F.count_if(F.col("n") >= 5).alias("large"), F.sum("n").alias("articles"))


def hourly_velocity(articles: DataFrame) -> DataFrame:
    """Articles by hour over the last 24 hours of the clock."""
    return articles.filter(F.col("created_at") >= _now() - F.expr("interval 24 hours")).groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def daily_volume(articles: DataFrame, days: int = 30) -> DataFrame:
    """Articles per source and day over `days` days, absent days as 0."""
    calendar = articles.select("source").distinct().select(
        "source", F.explode(F.sequence(F.date_sub(F.to_date(_now()), days), F.date_sub(F.to_date(_now()), 1)).cast("array<string>")).alias("day")
    )
    counts = articles.groupBy("source", F.to_date("created_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, ["source", "day"], "left").select("source", "day", F.coalesce("n", F.lit(0)).alias("n"))


def top_categories(articles: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent categories of each source (A10)."""
    counts = articles.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "category"))
    return counts.withColumn("place", place).filter(F.col("place") <= most)


def facets(articles: DataFrame, most: int = 12) -> DataFrame:
    """The `most` most frequent sources and categories (A3)."""
    def top(axis: str) -> DataFrame:
        counts = articles.groupBy(F.col(axis).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return counts.orderBy(F.desc("n"), "value").limit(most).select(F.lit(axis).alias("axis"), "value", "n")

    return top("source").unionByName(top("category"))


def latest_per_story(articles: DataFrame) -> DataFrame:
    """The newest article of each story, with its span and size."""
    last = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("created_at"), F.desc("id")))
    every = Window.partitionBy("cluster_id")
    return (
        articles.select("cluster_id", "id", "source", "created_at", last.alias("r"), F.min("created_at").over(every).alias("first_at"), F.count(F.lit(1)).over(every).alias("n"))
        .filter("r = 1").drop("r")
    )


def funnel(articles: DataFrame) -> DataFrame:
    """Views, clicks and purchases by source with click rate; no views gives rate 0."""
    of = lambda k: F.count_if(F.col("category") == k)
    sums = articles.groupBy("source").agg(of("view").alias("views"), of("click").alias("clicks"), of("purchase").alias("purchases"))
    rate = F.when(F.col("views") > 0, quantised(100.0 * F.col("clicks") / F.col("views"), 1)).otherwise(F.lit(0.0))
    return sums.withColumn("click_rate", rate)


def period_compare(articles: DataFrame) -> DataFrame:
    """Articles by category in the last 7 days and the 7 before, with the change (A5)."""
    back = lambda d: _now() - F.expr(f"interval {d} days")
    at = F.col("created_at")
    sums = articles.groupBy("category").agg(F.count_if((at >= back(7)) & (at < _now())).alias("now"), F.count_if((at >= back(14)) & (at < back(7))).alias("before"))
    return sums.withColumn("change", F.col("now") - F.col("before"))


def unsummarised(articles: DataFrame) -> DataFrame:
    """Stories of two articles or more that no `purchase` row (standing in for a summary) closes."""
    done = articles.filter("category = 'purchase'").select("cluster_id")
    return articles.join(done, "cluster_id", "left_anti").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest")).filter("n >= 2")


#: Of source_pairs: members of stories a block holds about, blocks at least, pairs counted at once (few, so caches hold them).
BLOCK_MEMBERS, LEAST_BLOCKS, PAIRS_AT_ONCE = 4_000_000, 6, 250_000


def _shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, least: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, n): sources of two blocks (y of the first where there is no second), each given as numbers of stories and
    sources in them, with `least` stories or more in both, each pair once; at most `at_once` pairs, or those of one
    source, are counted at a time."""
    x, xs = pd.factorize(left[1])
    y, ys = (x, xs) if right is None else pd.factorize(right[1])
    mine, theirs = left[0], left[0] if right is None else right[0]
    order = np.lexsort((y, theirs))
    held, y = np.bincount(theirs, minlength=int(mine.max(initial=-1)) + 1), y[order]
    starts = np.cumsum(held) - held
    order = np.argsort(x, kind="stable")
    mine, x = mine[order], x[order]
    ends = np.cumsum(np.bincount(x, minlength=len(xs)))  # of each source's rows
    work = np.concatenate([[0], np.cumsum(held[mine])])
    upto_work = work[ends]
    source = 0
    while source < len(xs):
        first = ends[source - 1] if source else 0
        upto = max(source + 1, int(np.searchsorted(upto_work, work[first] + at_once, "right")))
        rows = slice(first, ends[upto - 1])
        n = held[mine[rows]]
        at = np.arange(n.sum()) + np.repeat(starts[mine[rows]] - (np.cumsum(n) - n), n)
        key = np.repeat((x[rows] - source) * len(ys), n) + y[at]
        if (upto - source) * len(ys) <= 4 * len(key):
            counts = np.bincount(key)
            found = np.flatnonzero(counts >= least)
            counts = counts[found]
        else:
            found, counts = np.unique(key, return_counts=True)
            found, counts = found[counts >= least], counts[counts >= least]
        a, b = np.divmod(found, len(ys))
        if right is None:
            later = b > a + source
            a, b, counts = a[later], b[later], counts[later]
        if len(a):
            yield xs[a + source], ys[b], counts
        source = upto


def source_pairs(articles: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of sources with shared stories.

    Sources are dealt into blocks, and each two blocks meet in a task of their own that counts their pairs some at a time,
    so that no pair but a result leaves it. What is shuffled, once a block, is a row a story with its sources of the block.
    """
    member = written(articles.filter("cluster_id is not null and source is not null").select("cluster_id", "source").distinct(), "members")
    n = max(LEAST_BLOCKS, -(-member.count() // BLOCK_MEMBERS))
    block = F.pmod(F.xxhash64("source"), F.lit(n)).cast("int")
    held = member.groupBy(block.alias("own"), "cluster_id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    sides = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<int>")))
    sides = sides.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "cluster_id", "sources")
    kind = articles.schema["source"].dataType.simpleString()
    limit = PAIRS_AT_ONCE

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(i: int, j: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            stories = pd.factorize(rows["cluster_id"].to_pandas())[0]
            second = rows["second"].to_numpy()

            def side(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                sources = rows["sources"].take(pa.array(at))
                return np.repeat(stories[at], pc.list_value_length(sources).to_numpy()), pc.list_flatten(sources).to_numpy()

            for x, y, shared in _shared(side(np.flatnonzero(~second)), None if i == j else side(np.flatnonzero(second)), least, limit):
                for at in range(0, len(x), 1 << 17):
                    cut = slice(at, at + (1 << 17))
                    yield pa.record_batch([pa.array(x[cut], source), pa.array(y[cut], source), pa.array(shared[cut], pa.int64())], names=["x", "y", "shared"])

        now, parts, source = None, [], None
        for batch in batches:
            source = batch.schema.field("sources").type.value_type
            key = batch.column("i").to_numpy() * n + batch.column("j").to_numpy()
            for cut in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(cut):
                    continue
                if now is not None and key[cut[0]] != now:
                    yield from pairs(now // n, now % n, parts)
                    parts = []
                now = key[cut[0]]
                parts.append(batch.slice(cut[0], len(cut)))
        if parts:
            yield from pairs(now // n, now % n, parts)

    # numbers of pairs (i, j), i <= j, without a gap
    dealt = sides.repartitionById(n * (n + 1) // 2, F.expr("cast(j * (j + 1) div 2 + i as int)")).sortWithinPartitions("i", "j")
    found = dealt.mapInArrow(counted, f"x {kind}, y {kind}, shared long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def cluster_score(articles: DataFrame) -> DataFrame:
    """Per story: sources times freshness decay of its newest article times the log of its size."""
    sums = articles.groupBy("cluster_id").agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    hours = (F.unix_micros(_now().cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
    return sums.withColumn("score", quantised(F.col("n_sources") * F.exp(-0.115 * hours) * F.log1p("n"))).drop("newest")


def pulse(articles: DataFrame) -> DataFrame:
    """Per story, 0 to 100: recency and volume of the last 24 hours."""
    at = F.col("created_at")
    sums = articles.groupBy("cluster_id").agg(F.count_if(at >= _now() - F.expr("interval 24 hours")).alias("fresh"), F.max(at).alias("newest"))
    recent = (
        F.when(F.col("newest") > _now() - F.expr("interval 1 hour"), 15).when(F.col("newest") > _now() - F.expr("interval 6 hours"), 8)
        .when(F.col("newest") >= _now() - F.expr("interval 24 hours"), 3).otherwise(0)
    )
    return sums.select("cluster_id", (10 + 10 * F.least("fresh", F.lit(5)) + recent).cast("long").alias("pulse"))


def visitors(events: DataFrame) -> DataFrame:
    """Page views and distinct visitors by day."""
    return events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("visitors"))
