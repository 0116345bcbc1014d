"""The mix against a plain simulation of the queues."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

from tidewire.llm import mixing

SCHEMA = "doc_id long, text string, source string, row int, `at` string, times int, n string, `a.b` int"


def plain(rows):
    """Taken words by row number."""
    size = [len((t or "").split()) for _, t, *_ in rows]
    names = sorted({s for _, _, s, *_ in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(z for z, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, Fraction(3, 2) * sum(held.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * held[s] < weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: Fraction(2 * held[s]) for s in full}
        left, open_ = left - sum(2 * held[s] for s in full), open_ - full
    events = []
    for s in names:
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (hashlib.md5(b"" if rows[i][0] is None else str(rows[i][0]).encode()).hexdigest(), size[i]))
        cum = 0
        for epoch in (0, 1):
            for i in own:
                cum += size[i]
                if size[i] and target[s]:
                    events.append((float(Fraction(cum) / target[s]), "n" if s is None else "s" + s, epoch, i))
    taken, total = Counter(), 0
    for _, _, _, i in sorted(events, key=lambda e: e[:3]):
        total += size[i]
        if total > 1.5 * sum(size):
            break
        taken[i] += size[i]
    return size, {s: float(t) for s, t in target.items()}, taken


def table(seed, n, hot):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), r.choice("aabbbbbbcd"), 1, "x", 2, "y", 3) for i in range(n)]
    rows += [(r.randrange(n), "short text", "hot", 1, "x", 2, "y", 3) for _ in range(hot)]
    return [*rows, (9000, None, None, None, None, None, None, None), (9001, "a b", None, 1, "x", 2, "y", 3), (None, "x y z", "a", 1, "x", 2, "y", 3)]


@pytest.mark.parametrize(("seed", "n", "hot", "ranges"), [(1, 200, 0, 3), (2, 150, 300, 40), (3, 5, 0, 8)])
def test_mix_equals_the_queues(spark, seed, n, hot, ranges):
    rows = table(seed, n, hot)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    size, target, taken = plain(rows)
    got = mixing.fair_mix(docs, n_ranges=ranges).collect()
    want = Counter((r[0], r[2], size[i], taken[i]) for i, r in enumerate(rows))
    assert Counter((g.doc_id, g.source, g["size"], g.taken) for g in got) == want
    assert all(g.target == pytest.approx(target[g.source]) for g in got)
    mixed = mixing.mixed_documents(docs, n_ranges=ranges)
    assert mixed.columns == docs.columns
    have = Counter((g.doc_id, g.source, g["size"]) for g in got for _ in range(g.taken // max(1, g["size"])))
    assert Counter((m.doc_id, m.source, len(m.text.split())) for m in mixed.collect()) == have


def test_many_equal_rows_share(spark):
    rows = [(7, "one two", "a", i, "x", 2, "y", 3) for i in range(300)] + [(i, "w " * 9, "b", 1, "x", 2, "y", 3) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    taken = Counter()
    for g in mixing.fair_mix(docs, n_ranges=16).collect():
        taken[g.source] += g.taken
    mixed = Counter(m.source for m in mixing.mixed_documents(docs, n_ranges=16).collect())
    assert mixed["a"] * 2 == taken["a"] and mixed["b"] * 9 == taken["b"]
    copies = Counter(m.row for m in mixing.mixed_documents(docs, n_ranges=16).filter("source = 'a'").collect())
    assert max(copies.values()) <= 2


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.fair_mix(docs).count() == 0 == mixing.mixed_documents(docs).count()
    docs = spark.createDataFrame([(1, None, "a", 1, "x", 2, "y", 3), (2, " ", None, 1, "x", 2, "y", 3)], SCHEMA)
    assert [(g["size"], g.taken, g.target) for g in mixing.fair_mix(docs).collect()] == [(0, 0, 0.0)] * 2 and mixing.mixed_documents(docs).count() == 0
