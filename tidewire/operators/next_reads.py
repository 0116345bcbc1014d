"""What to read next after a story: stories that share names, tags or topics, by the first rule that fits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wording
from tidewire.operators.online import headline, ratio_overlap
from tidewire.operators.ranking import hours_since, ranked_rows, tier

#: Overlaps that part the rules, points of a rule and of each thing shared, points of trust and of freshness, and
#: what a result must reach.
NEXT, BACKGROUND, TOPICAL = 0.25, 0.22, 0.28
POINTS = {"development": (2.0, 0.22), "background": (1.6, 0.18), "angle": (1.35, 0.15), "topic": (1.05, 0.12), "general": (0.95, 0.08)}
TRUSTED, FRESH, FADES, LEAST, RESULTS = 0.35, 0.8, 0.08, 0.9, 4
GENERAL = ("vesti", "news")


def relation(names: int, tags: int, topics: list[str], overlap: float) -> tuple[str, int] | None:
    """The first rule that fits, and how many things it counts."""
    own = [t for t in topics if t.lower() not in GENERAL]
    if names and overlap >= NEXT:
        return "development", names
    if tags and overlap < BACKGROUND:
        return "background", tags
    if names:
        return "angle", names
    if own:
        return "topic", len(own)
    return ("general", len(topics)) if topics and overlap >= TOPICAL else None


def story_marks(news: DataFrame) -> DataFrame:
    """(cluster_id, kind, mark): the names of its headlines, its categories (which stand for tags) and its topics."""
    kinds = F.array(
        F.struct(F.lit("name").alias("kind"), wording.title_entities(headline(F.col("title"))).alias("marks")), F.struct(F.lit("tag").alias("kind"), F.array("category").alias("marks")),
        F.struct(F.lit("topic").alias("kind"), F.array("topic").alias("marks")),
    )
    rows = news.select("cluster_id", F.explode(kinds).alias("k")).select("cluster_id", "k.kind", F.explode("k.marks").alias("mark"))
    return rows.filter(F.trim("mark") != "").distinct()


def next_reads(news: DataFrame, story: str = "s3", most: int = RESULTS) -> DataFrame:
    """The best stories to read after one: (cluster_id, relation, score), to three digits, ties by cluster_id.

    Only stories that share a mark with it are looked at: its marks, those of one story, find them by a join.
    """
    marks = story_marks(news)
    own = marks.filter(F.col("cluster_id") == story).select("kind", "mark")
    shared = marks.filter(F.col("cluster_id") != story).join(F.broadcast(own), ["kind", "mark"])  # the marks of one story
    sums = shared.groupBy("cluster_id").agg(F.count_if(F.col("kind") == "name").alias("names"), F.count_if(F.col("kind") == "tag").alias("tags"), F.sort_array(F.collect_list(F.when(F.col("kind") == "topic", F.col("mark")))).alias("topics"))
    leads = ranked_rows(news).filter("rank = 1").select("cluster_id", wording.stems(headline(F.col("title"))).alias("tokens"), (tier(F.col("weight")) == "high").alias("trusted"), hours_since("created_at").alias("hours"))
    here = leads.filter(F.col("cluster_id") == story).select(F.col("tokens").alias("here"))  # one row
    rows = sums.join(leads, "cluster_id").join(F.broadcast(here))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if found := relation(r["names"], r["tags"], r["topics"], ratio_overlap(r["here"], r["tokens"])):
                    base, each = POINTS[found[0]]
                    score = base + each * found[1] + TRUSTED * r["trusted"] + max(0.0, FRESH - min(FRESH, r["hours"] * FADES))
                    out.append((r["cluster_id"], found[0], round(score, 3)))
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["cluster_id", "relation", "score"])

    return rows.mapInArrow(judge, "cluster_id string, relation string, score double").filter(F.col("score") > LEAST).orderBy(F.desc("score"), "cluster_id").limit(most)
