"""Severity against a plain version, held-out accuracy, and the bounds of the fit's sample."""

import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidewire.llm import toxicity

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic int, _id string"


def plain_grades(model, text):
    """Each feature once: whole words with an end mark, and their first 3 to 7 bytes."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = "".join(chr(b) if b >= 128 or chr(b).isalnum() else " " for b in low).encode("latin-1").split()
    keys = {zlib.crc32(w + b"$") for w in words} | {zlib.crc32(w[:n]) for w in words for n in (3, 4, 5, 6, 7) if len(w) >= n}
    z = sum(model.weights.get(k, 0.0) for k in keys)
    below = [1 / (1 + math.exp(-(t - z))) for t in model.thresholds] + [1.0]
    return [b - a for a, b in zip([0.0, *below], below, strict=False)]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.fit(*toxicity.sampled_features(docs, labels.filter("doc_id % 2 = 0")))


def test_severity_equals_plain_version(spark, fitted):
    model = fitted[2]
    texts = [r.text for r in fitted[0].limit(60).collect()] + [None, "", "word " * 200_000, "ÄÖ ß x"]
    rows = [(i, t, None, None, None, 9, "x") for i, t in enumerate(texts)] + [(0, texts[0], None, None, None, 9, "x"), (None, texts[1], None, None, None, 9, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.severity, r.p_toxic, r.grade, r.toxic) for r in toxicity.severity(docs, model).collect()))
    want = []
    for d, t, *_ in rows:
        p = plain_grades(model, t)
        want.append((d is None, d or 0, sum(k * x for k, x in enumerate(p)), 1 - p[0], int(np.argmax(p)), 1 - p[0] >= 0.5))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2:4] == pytest.approx(b[2:4], abs=1e-9) and a[4:] == b[4:]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert toxicity.severity(docs.limit(0), model).count() == 0 == toxicity.drop_toxic(docs.limit(0), model).count()


def test_accuracy_on_labels_left_out(fitted):
    docs, labels, model = fitted
    known = labels.filter("doc_id % 2 = 1").selectExpr("doc_id", "toxic as label")
    held = toxicity.severity(docs, model).join(known, "doc_id").toPandas()
    assert len(held) > 1000
    flag, called = held.label.to_numpy(), held.p_toxic.to_numpy() >= 0.5
    assert called[flag == 1].mean() >= 0.93 and called[flag == 0].mean() <= 0.04
    assert np.all(np.diff(model.thresholds) > 0)


def test_sample_is_bounded_and_counts_an_id_once(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300)), None, None, None, 0, "") for i in range(20)]
    rows += [(3, f"another text {j}", None, None, None, 0, "") for j in range(50)] + [(99, None, None, None, None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (99, 1), (5, None), (7, 7)], "doc_id long, toxic int")
    hashes, toxic = toxicity.sampled_features(docs, labels)
    assert len(hashes) == len(toxic) == 21 and toxic.sum() == 11
    hashes, toxic = toxicity.sampled_features(docs, labels, sample=4)
    assert len(hashes) == 8 and toxic.sum() == 4
    model = toxicity.fit(*toxicity.sampled_features(docs, labels.filter("toxic = 1")))
    assert not model.weights and toxicity.severity(docs, model).filter("toxic").count() == 0
    assert not toxicity.fit(*toxicity.sampled_features(docs.limit(0), labels)).weights


def test_stage_drops_what_severity_calls_toxic(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(*toxicity.sampled_features(docs, labels))
    want = sorted(r.doc_id for r in docs.collect() if plain_grades(model, r.text)[0] > 0.5)
    assert sorted(r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, "/root/testdata/sf0.01").collect()) == want


def test_every_feature_of_long_texts_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flag = {r.doc_id: r.toxic for r in labels.collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in flag)
    every = [np.array(sorted(toxicity.features(t.encode())), np.uint32) for _, t in rows]
    assert max(map(len, every)) > 4096
    want = toxicity.fit(every, np.array([flag[d] for d, _ in rows]))
    got = toxicity.fit(*toxicity.sampled_features(docs, labels))
    assert got.weights == want.weights and got.thresholds == want.thresholds
