"""Queries on articles whose results or costs change with the size of stories, against their SQL on small made tables."""

import random

import duckdb
import pandas as pd
import pytest

from tidewire.operators import stories
from tidewire.plans import registry


def both(spark, folder, name, events):
    """Rows by Spark and by SQL of a query on `events` (user_id, event_type, minutes of the day, k)."""
    frame = pd.DataFrame(events, columns=["user_id", "event_type", "minutes", "k"])
    frame["ts"] = (pd.Timestamp("2024-01-05") + pd.to_timedelta(frame["minutes"], unit="min")).astype("datetime64[us]")
    frame = frame.assign(event_id=range(len(frame)), value=1.0, props=[f'{{"k": {k}}}' for k in frame["k"]])
    path = f"{folder}/events.parquet"
    frame[["event_id", "ts", "user_id", "event_type", "value", "props"]].to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    plain = lambda t: sorted(tuple(None if pd.isna(x) else x for x in r) for r in t[sorted(t.columns)].itertuples(index=False))
    return plain(registry.queries()[name](spark, str(folder)).toPandas()), plain(con.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("late, stale", [(10, 0), (50, 1)])
def test_stale_stories_none_or_one(spark, tmp_path, late, stale):
    got, want = both(spark, tmp_path, "stale_stories", [(1, "purchase", 60, 3), (2, "view", 60 + late, 3)])
    assert got == want
    assert got[0][2] == stale


def test_source_pairs_of_many_blocks(spark, tmp_path, monkeypatch):
    """Pairs of blocks of a few members, counted a few pairs at a time, are those of the SQL; none is shuffled."""
    monkeypatch.setattr(stories, "BLOCK_MEMBERS", 40)
    monkeypatch.setattr(stories, "PAIRS_AT_ONCE", 50)
    rng = random.Random(3)
    events = [(rng.randrange(60), "view", rng.randrange(3) * 1440, rng.randrange(11)) for _ in range(500)]
    got, want = both(spark, tmp_path, "source_pairs", events)
    assert got == want
    assert len(got) > 500
    plan = registry.queries()["source_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_source_pairs_shuffles_a_row_a_story_and_block(spark, tmp_path, monkeypatch):
    """Members of a story go together to where blocks meet, not one by one; each two blocks have a task of their own."""
    monkeypatch.setattr(stories, "BLOCK_MEMBERS", 100)
    dealt, kind = [], type(spark.range(1))
    real = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda rows, n, key: dealt.append((rows.count(), n, sorted(r[0] for r in rows.select(key).distinct().collect()))) or real(rows, n, key))
    events = [(user, "view", 60, k) for user in range(200) for k in range(4)]
    got, want = both(spark, tmp_path, "source_pairs", events)
    assert got == want and len(got) == 200 * 199 // 2
    blocks = 8  # 800 members
    assert dealt == [(4 * blocks * blocks, blocks * (blocks + 1) // 2, list(range(blocks * (blocks + 1) // 2)))]
