"""Random-indexing vectors against a plain loop, held-out accuracy, and odd rows."""

import re
import zlib

import numpy as np
import pytest

from tidewire.llm import quality, queries

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, held_out int, score string"


def plain_tokens(text):
    out, last = [], None
    for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", text):
        out.append(t.lower())
        if t.lower() == last:
            out.append(b"=")
        if t.isupper() and len(t) > 1:
            out.append(b"^")
        last = t.lower()
    return out


def bucket(token):
    return 1 + zlib.crc32(token) % (quality.BUCKETS - 1)


TEXTS = ["The the THE cat, sat!! ON a MAT", None, "", "  \t\n", "x", "*** a *** a", "été Été ÉTÉ", "ab " * 50]


def test_tokens_are_those_of_a_plain_loop():
    for text in TEXTS:
        got = [i for ids in quality.tokens((text or "").encode()) for i in ids.tolist()]
        assert got == [bucket(t) for t in plain_tokens((text or "").encode())]


def test_contexts_are_those_of_a_plain_loop(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS * 3)], SCHEMA).repartition(3)
    index, want = quality.index_vectors().astype(int), np.zeros((quality.BUCKETS, quality.DIMS), int)
    for text in TEXTS * 3:
        own = [bucket(t) for t in plain_tokens((text or "").encode())]
        for i, w in enumerate(own):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if i != j:
                    want[w] += index[own[j]]
    want[0] = 0
    got = quality.context_sums(docs)
    got[0] = 0
    assert (got == want).all()


def test_long_texts_in_pieces(monkeypatch):
    text = b"word " * 2000 + b"x" * 3000 + b" end"
    whole = quality.tokens(text)
    monkeypatch.setattr(quality, "_PIECE", 999)
    assert len(whole) == 1 and b"".join(quality._pieces(text)) == text
    vectors = quality.word_vectors(np.random.default_rng(1).integers(-9, 9, (quality.BUCKETS, quality.DIMS)))
    assert quality.pooled(text, vectors)[-1] > 7  # nothing is left out


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    return queries.op12_quality(spark, DATA).join(labels, "doc_id").toPandas(), spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_held_out_documents_are_told_apart(spark, scored):
    rows, _ = scored
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert ((held.score >= 0.3).astype(int) == held.predicted).all()
    assert held[held.quality == 1].predicted.mean() >= 0.98 and held[held.quality == 0].predicted.mean() <= 0.1
    assert abs(held.score.mean() - held.quality.mean()) < 0.05  # calibrated


def test_odd_rows_are_scored(spark):
    docs = spark.createDataFrame([(None, None, 1, "x"), (1, "", 1, "x"), (2, "good text here.", 1, "x"), (2, "good text here.", 1, "x"), (3, "bad!! BAD!!", 1, "x"), (7, "w " * 100_000, 1, "x")], SCHEMA)
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 1), (None, 1), (1, 7), (7, None)], "doc_id long, quality int")
    got = quality.scores(docs, quality.learned(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    of = {r.doc_id: r for r in got}
    assert of[None].score == of[1].score and of[None].held_out is False
    none = spark.createDataFrame([], SCHEMA)
    assert quality.scores(none, quality.learned(none, labels)).count() == 0
    alone = quality.scores(docs, quality.learned(docs, labels.filter("quality = 1 and doc_id = 2"))).collect()
    assert all(r.predicted == 1 for r in alone)
    assert quality.scores(docs, quality.learned(docs, labels.limit(0))).count() == 6
