"""Timelines, overviews and summaries of stories. Greedy parts work on one bounded group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import wording
from tidewire.functions.scalars import numbers
from tidewire.operators.ranking import hours_since, weight
from tidewire.operators.stories import quantised

#: Newest articles of a story that a timeline tells of.
MOST_MEMBERS = 40


def timeline(frame: pd.DataFrame) -> pd.DataFrame:
    """One story's events: an article within six hours of an earlier event whose title shares over .65 of its words is
    absorbed, its source collected by the first such event (J17); labels by words, the first, the last of three (R57)."""
    frame = frame.sort_values(["hours", "id"])
    events: list[dict] = []
    for row in frame.itertuples():
        words = set((row.title or "").lower().split())
        for e in events:
            union = words | e["words"]
            if abs(row.hours - e["hours"]) < 6 and union and len(words & e["words"]) / len(union) > 0.65:
                if row.source not in e["sources"]:
                    e["sources"].append(row.source)
                break
        else:
            events.append({"id": row.id, "hours": row.hours, "words": words, "sources": [row.source]})
    kinds = {"official": {"government", "minister", "official"}, "reaction": {"react", "responds", "answer"}, "escalation": {"attack", "crisis", "worthless"}}
    out = []
    for i, e in enumerate(events):
        label = next((k for k, marks in kinds.items() if marks & e["words"]), "first" if i == 0 else "latest" if i == len(events) - 1 and len(events) >= 3 else "update")
        out.append((frame["cluster_id"].iloc[0], e["id"], i, ",".join(e["sources"]), label))
    return pd.DataFrame(out, columns=["cluster_id", "id", "place", "sources", "label"])


def story_timeline(news_rows: DataFrame) -> DataFrame:
    """The events of each story in order of time (J17, R57). A story has 40 articles at most: the newest count."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("created_at"), F.desc("id")))
    rows = news_rows.select("cluster_id", "id", "title", "source", (-hours_since("created_at")).alias("hours"), place.alias("r")).filter(F.col("r") <= MOST_MEMBERS).drop("r")
    return rows.groupBy("cluster_id").applyInPandas(timeline, "cluster_id string, id long, place int, sources string, label string")


def story_overview(news_rows: DataFrame) -> DataFrame:
    """An extractive overview of each story: the best-ranked title, up to three sentences of its article, one of each of
    the next two, and up to five sentences with numbers that no earlier part has (R43), as text."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("w"), F.desc("created_at"), "id")
    rows = news_rows.withColumn("w", weight()).withColumn("rank", F.row_number().over(order)).filter("rank <= 8")
    sentences = F.filter(F.split(F.trim(F.regexp_replace("description", "[ \t\n\r]+", " ")), r"(?<=[.!?]) "), lambda s: F.length(s) > 0)
    parts = rows.select("cluster_id", "rank", "title", F.slice(sentences, 1, 40).alias("s"))
    sums = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "s"))).alias("x"))
    lead = F.slice(F.get("x", F.lit(0))["s"], 1, 3)
    more = F.flatten(F.transform(F.slice("x", 2, 2), lambda a: F.slice(a["s"], 1, 1)))
    told = F.array_distinct(F.concat(lead, more))
    with_numbers = F.filter(F.flatten(F.transform("x", lambda a: a["s"])), lambda s: F.size(numbers(s)) > 0)
    facts = F.slice(F.array_except(with_numbers, told), 1, 5)
    return sums.select("cluster_id", F.get("x", F.lit(0))["title"].alias("headline"), F.array_join(told, " ").alias("lead"), F.size(facts).alias("n_facts"), F.array_join(facts, " ").alias("facts"))


def summary(frame: pd.DataFrame, most: int = 4) -> pd.DataFrame:
    """Up to four sentences of a story, each next the best by score, unlike those taken (words shared under .4), boosted
    1.3 by a new source, .3 a new name, 1.2 at the start (R44)."""
    found = []
    for row in frame.sort_values(["rank"]).itertuples():
        for i, s in enumerate(row.sentences):
            words = set(s.lower().split())
            if len(words) >= 4:
                names = {w for w in s.split()[1:] if w[:1].isupper()}
                found.append((0.1 * len(words) + 0.8 * (i == 0) + 0.5 * any(c.isdigit() for c in s) + 0.4 * len(names), row.source, words, names, s))
    taken, sources, names = [], set(), set()
    while len(taken) < most:
        best = None
        for score, source, words, own, s in found:
            if any(len(words & t) / len(words | t) > 0.4 for t, _ in taken):
                continue
            score *= (1.0 if source in sources else 1.3) * (1 + 0.3 * len(own - names)) * (1.2 if not taken else 1.0)
            if best is None or score > best[0]:
                best = (score, source, words, own, s)
        if best is None:
            break
        taken.append((best[2], best[4]))
        sources.add(best[1])
        names |= best[3]
    return pd.DataFrame({"cluster_id": [frame["cluster_id"].iloc[0]], "n": [len(taken)], "summary": [" ".join(s for _, s in taken)]})


def story_summary(news_rows: DataFrame) -> DataFrame:
    """A diverse summary of each story from the first 40 sentences of its eight best articles."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("w"), F.desc("created_at"), "id")
    sentences = F.slice(F.split(F.trim(F.regexp_replace(F.concat_ws(". ", "title", "description"), "[ \t\n\r]+", " ")), r"(?<=[.!?]) "), 1, 40)
    rows = news_rows.withColumn("w", weight()).select("cluster_id", "source", F.row_number().over(order).alias("rank"), sentences.alias("sentences")).filter("rank <= 8")
    return rows.groupBy("cluster_id").applyInPandas(lambda frame: summary(frame), "cluster_id string, n int, summary string")
