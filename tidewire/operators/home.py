"""The home page: sections filled one after another, each from what those before have left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.ranking import HARD_TOPICS, editor_signals, ranked_rows, story_scores
from tidewire.operators.selection import live_candidates, wire_candidates
from tidewire.tables import dropping, kept, written

#: Stories of the hero and the pool it is picked from; how near to the best a story with a summary may lead,
#: and may support; places of the sections, and how many the backfill sees to; where the feed begins.
HERO, POOL, LEAD_AMONG, LEAD_BAND, SUPPORT_BAND = 4, 20, 4, 0.90, 0.72
DEVELOPING, LEAST_DEVELOPING, LIVE, LEAST_LIVE, FOR_YOU, LEAST_FOR_YOU, FEED_START, WIRE, WIRE_PER_SOURCE = 10, 4, 4, 2, 6, 4, 5, 11, 2


def home_stories(news: DataFrame) -> DataFrame:
    """A row a story with what the sections go by. Two of three stories have a summary, by their number (a stand-in)."""
    first = ranked_rows(news).filter("rank = 1").select("cluster_id", "source", "topic", F.col("created_at").alias("at"))
    rows = story_scores(news).select("cluster_id", "n", "sources", "homepage").join(first, "cluster_id")
    rows = rows.join(editor_signals(news).select("cluster_id", "state", "importance", F.col("live").alias("live_score")), "cluster_id").join(live_candidates(news), "cluster_id")
    return rows.withColumn("has", F.regexp_extract("cluster_id", "([0-9]+)$", 1).cast("long") % 3 != 0)


def top(rows: DataFrame, section: str, order: list[Column], most: Column | int) -> DataFrame:
    """(section, place, key) of the first `most` rows of a small or limited table."""
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select(F.lit(section).alias("section"), "place", F.col("cluster_id").alias("key"))


def without(rows: DataFrame, *sections: DataFrame) -> DataFrame:
    """What the sections have left; they are of bounded size."""
    for s in sections:
        rows = rows.join(F.broadcast(s.select(F.col("key").alias("cluster_id"))), "cluster_id", "left_anti")
    return rows


def sections(stories: DataFrame) -> list[DataFrame]:
    """lead, supporting, developing, live, for_you, of home_stories(). Each is cut to its size before rows are numbered."""
    by_score = [F.desc("homepage"), F.col("cluster_id")]
    pool = written(stories.orderBy(*by_score).limit(POOL), "pool")
    best = pool.agg(F.max("homepage").alias("best"))  # one row
    near = lambda band: (F.col("has") & (F.col("homepage") >= F.col("best") * band) & (F.col("best") > 0)).cast("int")
    lead = top(pool.orderBy(*by_score).limit(LEAD_AMONG).join(F.broadcast(best)), "lead", [F.desc(near(LEAD_BAND)), *by_score], 1)
    lead = written(lead, "lead")
    helping = F.when(F.col("best") > 0, near(SUPPORT_BAND)).otherwise(F.col("has").cast("int"))
    supporting = written(top(without(pool, lead).join(F.broadcast(best)), "supporting", [F.desc(helping), *by_score], HERO - 1), "supporting")

    left = without(stories, lead, supporting)
    primary = (F.col("state").isin("breaking", "developing", "confirmed") & (F.col("sources") >= 2)) | (F.col("n") >= 2)
    stage = F.when(primary, 1).when((F.col("sources") >= 2) | F.col("has"), 2).otherwise(3)
    key = [F.col("stage"), F.desc("has"), F.desc("sources"), *by_score]
    rows = left.withColumn("stage", stage).orderBy(*key).limit(DEVELOPING)
    developing = written(top(rows, "developing", key, F.when(F.col("stage") == 1, DEVELOPING).otherwise(LEAST_DEVELOPING)), "developing")

    left = without(left, developing)
    live_order = [F.desc("live_score"), F.desc("importance"), F.desc("at"), F.col("cluster_id")]
    own = F.row_number().over(Window.partitionBy("source").orderBy(*live_order))
    chosen = left.filter("live").withColumn("own", own).filter("own = 1").orderBy(*live_order).limit(LIVE).select("cluster_id", F.lit(1).alias("stage"), "live_score", "importance", "at")
    chosen = written(chosen, "live")
    few = chosen.agg((F.count("*") < LEAST_LIVE).alias("few"))  # one row
    fits = (F.col("state") == "breaking") | F.col("topic").isin(*HARD_TOPICS) | (F.col("sources") >= 2) | F.col("live")
    more = left.join(F.broadcast(chosen.select("cluster_id")), "cluster_id", "left_anti").filter(fits).orderBy(F.desc("at"), "cluster_id").limit(LIVE)
    more = more.join(F.broadcast(few)).filter("few").select("cluster_id", F.lit(2).alias("stage"), F.lit(0.0).alias("live_score"), F.lit(0.0).alias("importance"), "at")
    live = written(top(chosen.unionByName(more), "live", [F.col("stage"), *live_order], LIVE), "live")

    feed = written(stories.orderBy(*by_score).limit(FEED_START + FOR_YOU), "feed")
    pos = F.row_number().over(Window.orderBy(*by_score))
    feed = feed.withColumn("pos", pos)
    fine = written(without(feed.filter((F.col("pos") > FEED_START) & F.col("live")), lead, supporting, developing, live).select("cluster_id", F.lit(1).alias("stage"), "pos", "homepage", "at"), "fine")
    few = fine.agg((F.count("*") < LEAST_FOR_YOU).alias("few"))  # one row
    head = feed.filter(F.col("pos") <= FEED_START).select(F.col("cluster_id").alias("key"))
    rest = without(left, live, head, fine.select(F.col("cluster_id").alias("key"))).orderBy(F.desc("homepage"), F.desc("at"), "cluster_id").limit(FOR_YOU)
    rest = rest.join(F.broadcast(few)).filter("few").select("cluster_id", F.lit(2).alias("stage"), F.lit(0).alias("pos"), "homepage", "at")
    for_you = top(fine.unionByName(rest), "for_you", [F.col("stage"), F.col("pos"), F.desc("homepage"), F.desc("at"), F.col("cluster_id")], FOR_YOU)
    return [lead, supporting, developing, live, for_you]


def wire(news: DataFrame) -> DataFrame:
    """The wire: its candidates, each title once (the newest), hard topics first, then the newest, two a source."""
    rows = news.join(wire_candidates(news).filter("wire").select("id"), "id").select("id", "source", "topic", "created_at", F.lower(F.trim("title")).alias("t")).filter("t <> ''")
    rows = rows.groupBy("t").agg(F.max_by(F.struct("id", "source", "topic", "created_at"), F.struct("created_at", -F.col("id"))).alias("x")).select("x.*")
    hard = F.col("topic").isin(*HARD_TOPICS).cast("int")
    order = [F.desc(hard), F.desc("created_at"), F.col("id")]
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy(F.coalesce("source", F.lit("unknown"))).orderBy(*order))).filter(F.col("own") <= WIRE_PER_SOURCE)
    return top(rows.orderBy(*order).limit(WIRE).withColumn("cluster_id", F.col("id").cast("string")), "wire", order, WIRE)


def home_page(news: DataFrame) -> DataFrame:
    """(section, place, key): stories of lead, supporting, developing, live and for_you, each once; articles of the wire."""
    with dropping(news.sparkSession):
        stories = written(home_stories(news), "stories")
        out = wire(news)
        for part in sections(stories):
            out = out.unionByName(part)
        return kept(out, "home")
