import pandas as pd

from tidewire.adapters import news
from tidewire.operators import grouping

DATA = "/root/testdata/sf0.001"


def test_timeline_absorbs_only_near_repeats():
    rows = [(1, "s", 0.0, "Town hit by a flood today", "x"), (2, "s", 5.0, "town hit by a flood today again", "y"), (3, "s", 5.5, "Town hit by a flood today", "x"), (4, "s", 7.0, "Town hit by a flood today", "z"), (5, "s", 8.0, "Minister speaks, government helps", "x"), (6, "s", 30.0, "All is well", "x")]
    got = grouping.timeline(pd.DataFrame(rows, columns=["id", "cluster_id", "hours", "title", "source"]))
    assert list(zip(got.id, got.sources, got.label, strict=True)) == [(1, "x,y", "first"), (4, "z", "update"), (5, "x", "official"), (6, "x", "latest")]


def test_whole_tables(spark):
    rows = news(spark, DATA)
    n = rows.count()
    line = grouping.story_timeline(rows).collect()
    assert len({r.cluster_id for r in line}) == rows.select("cluster_id").distinct().count() and len(line) <= n
    over = grouping.story_overview(rows).collect()
    assert all(r.n_facts <= 5 and r.headline is not None for r in over)
    brief = grouping.story_summary(rows).collect()
    assert len(brief) == len(over) and all(1 <= r.n <= 4 for r in brief)
