"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

import itertools
import random

import pytest

import corpus_pipeline
from tidewire.llm import near_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    out = []
    for base in range(12):
        words = [word() for _ in range(r.choice([60, 200, 900]))]
        out.append(" ".join(words))
        for share in (0.01, 0.02, 0.021, 0.03, 0.06):  # similarities on both sides of 0.8
            copy = list(words)
            for at in r.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[at] = word()
            out.append(" ".join(copy))
    hot = [word() for _ in range(300)]
    for i in range(40):
        copy = list(hot)
        for at in r.sample(range(300), r.randint(1, 5)):
            copy[at] = word()
        out.append(" ".join(copy))
    out += [None, "", "  ", "one two three four", "one two three five", "One two  three four", "word " * 400 + "a b c d e f g h i j", "word " * 400 + "k l m n o p q r s t"]
    return [(i, t, "en", "a", len(t or "")) for i, t in enumerate(out)] + [(None, "a null id alone " * 3, "en", "a", 1)]


def test_near_stage_equals_all_pairs(spark, rows):
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    sets = [shingles(r[1]) for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(find(i), []).append(r[0])
    least = sorted(min((d for d in v if d is not None), default=-1) for v in want.values())
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == least


def test_small_tiles_and_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    entries = near_texts.sketches(docs).dropDuplicates(["key"]).cache()
    groups = []
    for tile in (None, 7):
        links = near_texts.connected_components(near_texts.candidate_links(entries, tile=tile)).collect()
        by = {}
        for r in links:
            by.setdefault(r.root, set()).add(r.node)
        groups.append(sorted(map(sorted, by.values())))
    assert groups[0] == groups[1]
    sets = near_texts._sets(near_texts._rows(docs)).dropDuplicates(["key"])
    members = entries.join(sets, "key").selectExpr("0L as root", "key", "a", "b", "hashes").cache()
    found = []
    for tile in (1000, 9):
        by = {}
        for r in near_texts.connected_components(near_texts.similar_links(members, tile=tile)).collect():
            by.setdefault(r.root, set()).add(r.node)
        found.append(sorted(map(sorted, by.values())))
    assert found[0] == found[1]
    assert near_texts.near_copies(docs.limit(0)).collect() == []


def test_one_row_a_component_whatever_the_columns(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(7, text, i, "x", 1, 2) for i in (3, 1, 2)] + [(7, "other words altogether for this row", 0, "x", 1, 2), (7, text + "more", 0, "x", 1, 2), (3, None, 0, "x", 1, 2), (4, "", 0, "x", 1, 2), (None, text, 0, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, row string, t int, `first` int")
    got = near_texts.drop_near_copies(docs)
    assert got.columns == docs.columns
    found = sorted((r.doc_id, r.text, r.key) for r in got.collect() if r.text)
    assert len(found) == 2 + (jaccard(shingles(text), shingles(text + "more")) < 0.8)
    assert (7, text, 1) in found or (7, text + "more", 0) in found  # one id: the smaller hash
    assert (3, None) in [(r.doc_id, r.text) for r in got.collect()]
    one = near_texts.drop_near_copies(docs.filter(~docs.text.endswith("more"))).collect()
    assert (7, text, 1) in [(r.doc_id, r.text, r.key) for r in one]
    assert near_texts.drop_near_copies(docs.limit(0)).count() == 0
