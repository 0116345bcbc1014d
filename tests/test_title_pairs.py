"""Pairs of like titles against a plain loop, over classes of one title in several blocks."""

from tidewire.operators import selection


def rows(n):
    base = [f"word{i:02d}" for i in range(19)]
    titles = ["Rivers rise again", "again RIVERS rise", " ".join(base), " ".join(base[1:]), " ".join(base[2:]), " ".join([*base[:18], "other"]), " ".join(base[:9]), " ".join(base[:10]), "a b", None]
    return [(f"s{i}", titles[i % len(titles)]) for i in range(n)]


def test_pairs_equal_a_plain_loop(spark):
    table = [*rows(73), ("s5", "a title that is not the greatest"), (None, "Rivers rise again")]
    best = {}
    for story, title in table:
        if story is not None and title is not None:
            best[story] = max(best.get(story, ""), title)
    sets = {s: {w for w in t.lower().split() if len(w) >= 4} for s, t in best.items()}
    want = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and len(x & y) / len(x | y) >= 0.9:
                want.add((a, b, round(len(x & y) / len(x | y), 9)))
    news = spark.createDataFrame(table, "cluster_id string, title string")
    for block in (3, 500):
        got = [(r.a, r.b, round(r.overlap, 9)) for r in selection.title_pairs(news, block=block).collect()]
        assert len(got) == len(set(got))
        assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
        assert all(abs(dict(((a, b), v) for a, b, v in want)[a, b] - v) < 1e-3 for a, b, v in got)


def test_pairs_are_given_and_not_kept(spark):
    news = spark.createDataFrame(rows(60), "cluster_id string, title string")
    plan = selection.title_pairs(news)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Aggregate", "Join", "Sort", "Window"))
