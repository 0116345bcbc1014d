"""Every query of the engine against its SQL, on the smallest tables; those without SQL against plain loops."""

import os

import duckdb
import pytest

from tidewire.adapters import news
from tidewire.operators import ranking, selection
from tidewire.plans import registry

DATA = "/root/testdata/sf0.001"
#: Greedy operators, which SQL cannot say; tests/test_grouping.py and the tests below hold them against plain versions.
GREEDY = {"brief_picks", "home_page", "merge_plan", "next_reads", "online_stories", "ranked_in_story", "story_confidence", "story_overview", "story_summary", "story_timeline"}


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if x is None or x != x else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(db.execute(registry.oracle_sql()[name]).df())


def test_only_greedy_queries_lack_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == GREEDY


def words(title):
    return {w for w in (title or "").lower().split() if len(w) >= 4}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_ranks_in_stories(spark):
    table = news(spark, DATA)
    stories = {}
    for r in table.withColumn("w", ranking.weight()).collect():
        stories.setdefault(r.cluster_id, []).append(r)
    want = {}
    for own in stories.values():
        kept, redundant = [], {}
        for r in sorted(own, key=lambda r: (-(r.w + 0.12 * bool((r.description or "").strip())), r.id)):
            redundant[r.id] = any(jaccard(words(r.title), k) >= 0.85 for k in kept)
            if not redundant[r.id]:
                kept.append(words(r.title))
        best = sorted(own, key=lambda r: r.id)
        best.sort(key=lambda r: (r.w - 5 * redundant[r.id], r.created_at), reverse=True)
        want |= {r.id: (redundant[r.id], i + 1) for i, r in enumerate(best)}
    assert {r.id: (r.redundant, r["rank"]) for r in ranking.ranked_in_story(table).collect()} == want


def test_brief_picks(spark):
    table = news(spark, DATA)
    first = {r.cluster_id: r for r in ranking.ranked_rows(table).filter("rank = 1").collect()}
    best = sorted(ranking.story_scores(table).collect(), key=lambda r: (-r.synthesis, r.cluster_id))[:60]
    picked, topics, titles = [], {}, []
    for r in best:
        topic, own = first[r.cluster_id].topic, set((first[r.cluster_id].title or "").lower().split())
        if len(picked) < 8 and topics.get(topic, 0) < 2 and not any(jaccard(own, t) >= 0.72 for t in titles if own and t):
            picked.append(r.cluster_id)
            topics[topic] = topics.get(topic, 0) + 1
            titles.append(own)
    assert [r.cluster_id for r in sorted(selection.brief_picks(table).collect(), key=lambda r: r.place)] == picked
