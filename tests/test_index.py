"""Ranks by covers against a plain search for covers; the index is read, not the texts."""

import random
import re

from tidewire.operators import index, search

DATA = "/root/testdata/sf0.001"


def plain_rank(title, rest, query):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    terms, n = set(query.split()), len(words(title))
    hits = [(i, w, 1.0 if i < n else 0.4) for i, w in enumerate(words(title) + words(rest)) if w in terms]
    total, start = 0.0, 0
    while True:  # the first end from `start` on, then the last beginning for it
        end = next((j for j in range(start, len(hits)) if {h[1] for h in hits[start : j + 1]} == terms), None)
        if end is None:
            return total or None
        begin = next(i for i in range(end, start - 1, -1) if {h[1] for h in hits[i : end + 1]} == terms)
        own = hits[begin : end + 1]
        noise = own[-1][0] - own[0][0] - (len(own) - 1)
        total += len(own) / sum(1 / h[2] for h in own) / (1 + noise)
        start = begin + 1


def test_ranks_are_those_of_covers(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcxyz") for _ in range(r.randint(0, 4))), " ".join(r.choice("abcdefxyz") for _ in range(r.randint(0, 25)))) for i in range(60)]
    rows += [(100, None, None), (101, "", "a"), (102, "A, b!", "c-a")]
    table = index.postings(spark.createDataFrame(rows, "id long, title string, description string"))
    for query in ("a", "a b", "a b c", "B a", "a nowhere"):
        got = {x.id: x["rank"] for x in index.ranks(table, query).collect()}
        want = {i: plain_rank(t, d, query.lower()) for i, t, d in rows}
        assert got.keys() == {i for i, w in want.items() if w}
        assert all(abs(got[i] - want[i]) < 1e-5 for i in got)


def test_searches_read_the_index(spark):
    index.forget(DATA)
    search.word_search(spark, DATA).collect()
    plan = search.hybrid_search(spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "regexp_extract_all" not in plan and "In(term" in plan.replace("in(term", "In(term")
    one = search.word_search(spark, DATA, query="of").collect()
    assert one and all(x["rank"] > 0 for x in one)


def test_words_of_an_article_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(index, "AT_ONCE", 2)
    rows = [(1, "A b a", "b c"), (2, None, None), (3, "", "a"), (4, "b", None), (5, "Ж ж", "ж a")]
    found = index.postings(spark.createDataFrame(rows, "id long, title string, description string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {("a", 1): (3, [0, 2]), ("b", 1): (3, [1, 3]), ("c", 1): (3, [4]), ("a", 3): (0, [0]), ("b", 4): (1, [0]), ("ж", 5): (2, [0, 1, 2]), ("a", 5): (2, [3])}
    assert {(r.term, r.id): (r.n_title, r.positions) for r in found.collect()} == want
