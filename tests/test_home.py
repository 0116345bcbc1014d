"""The home page against a plain assembly of its sections."""

import random
from datetime import datetime, timedelta

from tidewire.adapters import news
from tidewire.operators import home
from tidewire.tables import dropping

DATA = "/root/testdata/sf0.001"
HARD = {"politics", "economy", "crime", "sport", "technology"}
FIELDS = "cluster_id string, n long, sources long, homepage double, source string, topic string, at timestamp, state string, importance double, live_score double, live boolean, has boolean"


def plain(rows):
    score = lambda r: (-r["homepage"], r["cluster_id"])
    rows = sorted(rows, key=score)
    out, gone = [], set()

    def put(section, chosen):
        for i, r in enumerate(chosen):
            out.append((section, i + 1, r["cluster_id"]))
            gone.add(r["cluster_id"])

    pool = rows[:20]
    if not pool:
        return set()
    top = pool[0]["homepage"]
    put("lead", [next((r for r in pool[:4] if r["has"] and top > 0 and r["homepage"] >= 0.9 * top), pool[0])])
    put("supporting", sorted((r for r in pool if r["cluster_id"] not in gone), key=lambda r: (-(r["has"] and (top <= 0 or r["homepage"] >= 0.72 * top)), *score(r)))[:3])
    left = [r for r in rows if r["cluster_id"] not in gone]
    stage = lambda r: 1 if (r["state"] in ("breaking", "developing", "confirmed") and r["sources"] >= 2) or r["n"] >= 2 else 2 if r["sources"] >= 2 or r["has"] else 3
    grown = []
    for k in (1, 2, 3):
        for r in sorted((r for r in left if stage(r) == k), key=lambda r: (-r["has"], -r["sources"], *score(r))):
            if len(grown) < (10 if k == 1 else 4):
                grown.append(r)
    put("developing", grown)
    left = [r for r in rows if r["cluster_id"] not in gone]
    sources, live = set(), []
    for r in sorted((r for r in left if r["live"]), key=lambda r: (-r["live_score"], -r["importance"], -r["at"].timestamp(), r["cluster_id"])):
        if r["source"] not in sources and len(live) < 4:
            sources.add(r["source"])
            live.append(r)
    if len(live) < 2:
        for r in sorted(left, key=lambda r: (-r["at"].timestamp(), r["cluster_id"])):
            if r not in live and len(live) < 4 and (r["state"] == "breaking" or r["topic"] in HARD or r["sources"] >= 2 or r["live"]):
                live.append(r)
    put("live", live)
    pool = [r for r in rows[5:11] if r["live"] and r["cluster_id"] not in gone]
    if len(pool) < 4:
        ids = {r["cluster_id"] for r in pool} | gone
        pool += sorted((r for r in rows[5:] if r["cluster_id"] not in ids), key=lambda r: (-r["homepage"], -r["at"].timestamp(), r["cluster_id"]))[: 6 - len(pool)]
    put("for_you", pool)
    return set(out)


def found(stories):
    with dropping(stories.sparkSession):
        return {tuple(r) for part in home.sections(stories) for r in part.collect()}


def test_sections_of_made_stories(spark):
    for seed, n in ((1, 60), (2, 25), (3, 9), (4, 1), (5, 0)):
        r, rows = random.Random(seed), []
        for i in range(n):
            rows.append((f"s{i}", r.randint(1, 2) if seed != 2 else 1, r.choice([1, 1, 2, 3]) if seed != 2 else 1, r.choice([0.0, 1.0, 5.0, 5.2, r.random() * 6]), f"src{r.randint(0, 4)}", r.choice(["politics", "fun", "life"]),
                         datetime(2024, 1, 1) + timedelta(minutes=r.randint(0, 5000)), r.choice(["stale", "singleton", "breaking"]), r.random(), float(r.randint(0, 5)), r.random() < [0.5, 0.1][seed % 2], r.random() < 0.4))
        stories = spark.createDataFrame(rows, FIELDS)
        assert found(stories) == plain([x.asDict() for x in stories.collect()])


def test_home_of_the_news(spark):
    table = news(spark, DATA)
    page = [tuple(r) for r in home.home_page(table).collect()]
    stories = [k for s, _, k in page if s != "wire"]
    assert len(stories) == len(set(stories))
    assert {p for p in page if p[0] != "wire"} == plain([x.asDict() for x in home.home_stories(table).collect()])
    wire = [k for s, _, k in sorted(page) if s == "wire"]
    rows = {str(r.id): r for r in table.collect()}
    assert 0 < len(wire) <= 11 and max(sum(rows[k].source == s for k in wire) for s in {rows[k].source for k in wire}) <= 2
    assert len({rows[k].title.strip().lower() for k in wire}) == len(wire)
