"""Merges of stories against a greedy walk and against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from pyspark.sql import functions as F

from tidewire.operators import merges, online

DATA = "/root/testdata/sf0.001"


def walk(pairs, sizes):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    done, out = set(), set()
    size = lambda c: (-sizes.get(c, (1, 1))[0], -sizes.get(c, (1, 1))[1], c)
    for hub in sorted(near, key=lambda c: (-len(near[c]), *size(c))):
        own = [] if hub in done else sorted(near[hub] - done)
        if own:
            star = [hub, *own]
            done |= set(star)
            best = min(star, key=size)
            out |= {(c, best) for c in star if c != best}
    return out


def stars(spark, pairs, sizes=None):
    frame = spark.createDataFrame(pairs, "a string, b string")
    table = spark.createDataFrame([(k, *v) for k, v in sizes.items()], "id string, n long, n_sources long") if sizes else None
    return {(r.story, r.into) for r in merges.star_merges(frame, table).collect()}


def test_no_chain_and_nothing_left(spark):
    assert stars(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")]) == walk([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], {})
    assert ("e", "d") in stars(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")])
    assert stars(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("x", "y"), ("x", "x"), ("y", "x")]) == {("b", "a"), ("c", "a"), ("e", "a"), ("y", "x")}
    assert merges.star_merges(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_as_by_a_walk(spark, seed):
    r = random.Random(seed)
    names = [f"s{i:02}" for i in range(50)]
    pairs = sorted({tuple(sorted(r.sample(names, 2))) for _ in range([40, 70, 110][seed])})
    sizes = {n: (r.randint(1, 4), r.randint(1, 2)) for n in names}
    assert stars(spark, pairs, sizes) == walk(pairs, sizes)


def head(title, names=(), category="m", topic="p", e=None, newest=0.0):
    tokens = title.lower().split()
    return {"tokens": tokens, "entities": list(names), "category": category, "topic": topic, "titles": [tokens], "e": e, "hours": newest, "newest": newest}


def test_matches_of_two_stories():
    same = "mayor opens bridge over river"
    assert merges.matching_overlap(head(same), head(same)) == 1.0
    assert merges.matching_overlap(head(same, e=[1.0, 0.0]), head(same, e=[0.0, 1.0])) is None  # different vectors
    assert merges.matching_overlap(head("mayor visits school today"), head("bridge collapses near harbour")) is None
    assert merges.matching_overlap(head("petrov opens school today", ["petrov"]), head("bridge collapse angers petrov", ["petrov"])) is None
    assert merges.matching_overlap(head("petrov and lindqvist open talks", ["petrov", "lindqvist"]), head("talks between petrov and lindqvist go on", ["petrov", "lindqvist"])) is not None


def test_confidence_of_two_stories():
    a, b = head("mayor opens bridge over river"), head("mayor opens new bridge")
    assert merges.confidence(a, b) > 0.36
    assert merges.confidence(a, b | {"topic": "x"}) == 0.0 and merges.confidence(a, b | {"category": "x"}) == 0.0
    assert merges.confidence(a, b | {"newest": 37.0}) == 0.0 and merges.confidence(a, b | {"newest": 36.0}) > 0
    general = {"topic": "vesti"}
    assert merges.confidence(a | general, b | general) == 0.0
    tagged = {"topic": "vesti", "entities": ["mayor", "bridge"]}
    assert merges.confidence(a | tagged, b | tagged) > 0.5


def test_pairs_of_the_news_against_all_pairs(spark):
    heads = merges.news_heads(spark, DATA)
    rows = [r.asDict(recursive=True) for r in heads.collect()]
    every = {tuple(sorted((a["id"], b["id"]))) for i, a in enumerate(rows) for b in rows[:i] if merges.matching_overlap(a, b) and abs(a["day"] - b["day"]) <= 1}
    found = {(r.a, r.b) for r in merges.repair_pairs(heads, 31 * 24).collect()}
    assert found <= every | {tuple(sorted(p)) for p in every} and len(found) >= 0.8 * len(every)
    plan = {(r.story, r.into) for r in merges.merge_plan(spark, DATA).collect()}
    assert plan == walk(found, {r["id"]: (r["n"], r["n_sources"]) for r in rows})
    sure = {(r.a, r.b): r.confidence for r in merges.story_confidence(spark, DATA).collect()}
    of = {r["id"]: r for r in rows}
    assert all(merges.confidence(of[a], of[b]) == c > 0 for (a, b), c in sure.items())


def test_pairs_that_cannot_be_one_are_not_judged(spark):
    """Of 30 stories a day that share a word, those of other topics, or with far vectors, are left out where words meet."""
    day = lambda i: (f"s{i:02}", 5, ["bridge", f"w{i}"], [], ["n"], f"t{i % 6}", "m", [[]], 100.0 + i % 2, [float(i % 5 == k) for k in range(5)])
    rows = spark.createDataFrame([day(i) for i in range(30)], "id string, day long, tokens array<string>, entities array<string>, x array<string>, topic string, category string, titles array<array<string>>, newest double, e array<double>")
    loose = {(r.a, r.b) for r in merges.story_pairs(rows.filter("id < 's06'")).collect()}
    assert len(loose) == 15
    rows = rows.filter("id < 's06'")
    near = {(r.a, r.b) for r in merges.story_pairs(rows, gate=merges.GATE).collect()}
    assert near == {("s00", "s05")}
    assert merges.story_pairs(rows, topical=True).count() == 0
    same = rows.withColumn("topic", F.lit(None).cast("string"))
    assert {(r.a, r.b) for r in merges.story_pairs(same, topical=True).collect()} == loose


def test_common_letters_bound_matching_blocks():
    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randrange(40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert online.common_letters(a, b) == table[-1][-1] >= sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
