"""License notices against all spans of words with their edit distance, and against plain places of phrases."""

import random
import re

import pytest

from tidewire.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score string, n_words string"


def distances(notice, text, start, longest):
    """Edit distance of the notice to text[start:end], by end."""
    row = list(range(len(notice) + 1))
    out = {start: row[-1]}
    for end in range(start + 1, min(len(text), start + longest) + 1):
        new = [row[0] + 1]
        for j, c in enumerate(notice, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != text[end - 1])))
        row = new
        out[end] = row[-1]
    return out


def spans(text, notice, k):
    """All (edits, start, end) within k edits that begin and end at edges of words."""
    edges = [i for i, c in enumerate(text) if c == 32]
    out = []
    for a in edges[:-1]:
        found = distances(notice, text, a + 1, len(notice) + k)
        out += [(found[b], a + 1, b) for b in edges if b > a + 1 and found.get(b, k + 1) <= k]
    return out


def damaged(r, notice, edits):
    text = list(notice.decode())
    for _ in range(edits):
        k, at = r.random(), r.randrange(len(text))
        if k < 0.4:
            text[at] = r.choice("abcxyz ")
        elif k < 0.7:
            text.insert(at, r.choice("abc "))
        else:
            del text[at]
    return "".join(text).split()


@pytest.mark.parametrize("seed", range(12))
def test_every_span_counts_or_overlaps_a_better_one(seed):
    r = random.Random(seed)
    notices = dict(r.sample(sorted(licenses.NOTICES.items()), 3) + [(b"under the mit license", "mit"), (b"apache license version 2", "apache-2")])
    tokens = []
    for _ in range(25):
        tokens += damaged(r, r.choice(sorted(notices)), r.randint(0, 4)) if r.random() < 0.7 else [r.choice(["the", "license", "of", "a", "version"])]
    text = (" " + " ".join(tokens) + " ").encode()
    found = licenses.NoticeFinder(notices).find(text)
    for notice, label in notices.items():
        k = licenses.allowed_edits(notice)
        every = spans(text, notice, k)
        # A label of two notices: keep what is a span of this one.
        kept = [(e, a, b) for a, b, x, e in found if x == label and (e, a, b) in every]
        for e, a, b in every:
            assert any(f <= e and c < b and a < d for f, c, d in kept), (notice, text[a:b], e)
    for a, b, label, e in found:
        assert any((e, a, b) in spans(text, n, licenses.allowed_edits(n)) for n, x in notices.items() if x == label)


def test_neighbours_and_edges_of_words():
    find = licenses.NoticeFinder().find
    assert [x[3] for x in find(b" apache license version 3 apache license version 2 ")] == [1, 0]
    assert len([x for x in find(b" under the mti license under the mit license ") if x[2] == "mit"]) == 2
    assert find(b" plunder the mit licensed ") == []
    assert len(find(b" all rights reserved" * 2000 + b" ")) == 2000


def plain_report(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    words = [w.decode("utf-8", "replace") for w in words]
    at = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def check(spark, docs, rows):
    got = sorted(((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_report(docs).collect()), key=repr)
    assert got == sorted(((repr(d), *plain_report(t)) for d, t in rows), key=repr)


def test_base_places(spark):
    long = "word " * 100_000 + "CC-BY/NC"
    rows = [(1, "Under the MIT License, Apache License (Version 2) cc by nc cc by nc"), (2, None), (3, ""), (4, "été under the mit licensé"), (None, long), (1, "Under the MIT License"), (1, "Under the MIT License"), (5, "under the mit"), (6, "a\x7fcc\x00by\x2fnc")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    check(spark, docs, rows)
    report = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    assert report[1].labels in ("mit", "apache-2,cc-by-nc,mit") and report[4].base_labels == "" and report[4].labels == "mit" and 0 < report[4].score < 1
    assert report[2].score == 0 and report[2].labels == "" and report[5].n_base == 0
    assert licenses.license_report(docs.limit(0)).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
