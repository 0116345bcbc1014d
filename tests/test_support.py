"""Support of claims, by example and against plain cosines."""

import re
from collections import Counter
from math import sqrt

from tidewire.operators import support


def cosine(a, b):
    x, y = (Counter(re.findall(r"\w+", t.lower())) for t in (a, b))
    return sum(x[w] * y[w] for w in x) / sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_sentences_claims_and_stretches(spark):
    texts = spark.createDataFrame([("s", "Short one. This claim is long enough to count! <b>And so</b> is this other claim here?  No."), ("t", None)], "story string, text string")
    assert [(r.story, r.claim, r.text) for r in support.claims_of(texts).collect()] == [("s", 1, "This claim is long enough to count!"), ("s", 2, "And so is this other claim here?")]
    body = " ".join(f"Sentence number {i} of this body." for i in range(7)) + " Tiny."
    sources = spark.createDataFrame([("s", 1, "A title", body), ("s", 2, "A title", None), ("s", 3, "", "")], "story string, id long, title string, body string")
    found = sorted(r.text for r in support.stretches_of(sources).collect())
    assert found[0] == "A title" and len(found) == 3  # the seventh sentence alone is too short
    assert found[1] == " ".join(f"Sentence number {i} of this body." for i in range(3))


def test_best_support_is_the_greatest_cosine(spark):
    claims = [("s", 1, "The river rose and the town was flooded"), ("s", 2, "Zebras quite unlike anything"), ("t", 1, "Nothing in this story supports it")]
    stretches = [("s", "a", "The river rose by two metres on Monday"), ("s", "b", "The town by the river was flooded at night"), ("t", "c", "zzz yyy")]
    got = {(r.story, r.claim): r.support for r in support.best_support(spark.createDataFrame(claims, "story string, claim int, text string"), spark.createDataFrame(stretches, "story string, stretch string, text string")).collect()}
    want = {(s, c): max(cosine(t, u) for v, _, u in stretches if v == s) for s, c, t in claims}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_share_of_supported_claims(spark):
    claims = spark.createDataFrame([("s", 1, "The river rose and the town was flooded"), ("s", 2, "Zebras quite unlike anything"), ("u", 1, "Only one stretch here")], "story string, claim int, text string")
    stretches = spark.createDataFrame([("s", "a", "The river rose by two metres"), ("s", "b", "The town was flooded"), ("u", "c", "Only one stretch here")], "story string, stretch string, text string")
    assert [tuple(r) for r in support.supported(claims, stretches).collect()] == [("s", 2, 1, 0.5)]


def test_words_of_stretches_are_not_shuffled(spark):
    claims = spark.createDataFrame([("s", 1, "The river rose and rose again"), ("s", 2, "?? -- !!"), ("s", 3, "Straße in İzmir, Ünal's 2nd")], "story string, claim int, text string")
    stretches = spark.createDataFrame([("s", "a", "a river rose"), ("s", "b", "..."), ("s", "c", "STRASSE straße İZMIR 2nd")], "story string, stretch string, text string")
    found = support.best_support(claims, stretches)
    got = {r.claim: r.support for r in found.collect()}
    assert abs(got[1] - cosine("The river rose and rose again", "a river rose")) < 1e-9 and got[2] == 0.0 and 0 < got[3] < 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # a row a stretch, not a row a word
