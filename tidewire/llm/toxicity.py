"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity has four grades: 0 for clean, 1 to 3 for toxic rows by terciles of how many distinct telling words they
hold. One weight vector serves all grades; ordered thresholds part them: P(grade <= k) = sigmoid(threshold_k - w.x).
Features are words and their leading bytes, present or not, hashed by CRC-32, and kept where the sample's chi-square
against the toxic label is telling. The model is fitted on the driver from a bounded sample of labelled rows; every
document is scored over its whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._store import scratch, written
from tidewire.llm._texts import texts, words

#: Rows of each label (toxic, clean) that the fit reads at most, smallest MD5 of the doc_id first.
SAMPLE = 4000
PREFIXES = (3, 4, 5, 6, 7)
GRADES = 4
#: A feature is kept from so many toxic rows and this chi-square on.
LEAST_ROWS, LEAST_CHI2, MOST_FEATURES = 3, 12.0, 20_000
#: A document is toxic from this probability of a grade above 0 on.
THRESHOLD = 0.5
#: Steps and weight decay of the fit.
_STEPS, _L2 = 400, 1e-3
#: Words whose features a worker remembers.
_CACHED_WORDS = 100_000


def features_of(word: bytes) -> list[int]:
    """Hashes of a word, whole (with an end mark) and by its leading bytes."""
    crc = zlib.crc32
    return [crc(word + b"$"), *[crc(word[:n]) for n in PREFIXES if len(word) >= n]]


def features(text: bytes) -> set[int]:
    """Hashes of a text's distinct words."""
    return {k for w in set(words(text)) for k in features_of(w)}


@dataclass
class OrdinalModel:
    """Cumulative-link model: weights of hashed features and ordered thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [30.0, 31.0, 32.0])  # nothing is toxic

    def __post_init__(self) -> None:
        self._known: set[bytes] = set()
        self._telling: dict[bytes, list[int]] = {}

    def grades(self, text: bytes) -> np.ndarray:
        """Probability of each grade. Each feature counts once, however many words have it."""
        found = set(words(text))
        if new := found - self._known:
            if len(self._known) + len(new) > _CACHED_WORDS:
                self._known.clear()
                self._telling.clear()
                new = found
            self._known |= new
            for word in new:
                if keys := [k for k in features_of(word) if k in self.weights]:
                    self._telling[word] = keys
        keys = {k for word in found & self._telling.keys() for k in self._telling[word]}
        z = math.fsum(self.weights[k] for k in keys)
        below = _sigmoid(np.array(self.thresholds) - z)
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _telling(hit: Column, rows: Column, n_toxic: int, n: int) -> tuple[Column, Column]:
    """Whether a feature of `rows` sampled rows, `hit` of them toxic, is kept, and its chi-square; as in fit()."""
    expect = rows * n_toxic / n
    chi2 = (hit - expect) * (hit - expect) / (expect * (1 - n_toxic / n) * F.greatest(F.lit(1e-9), 1 - rows / n) + 1e-9)
    lift = (hit / n_toxic) / F.greatest(F.lit(1e-9), (rows - hit + 0.5) / (n - n_toxic + 1))
    return (hit >= min(LEAST_ROWS, n_toxic)) & (chi2 >= LEAST_CHI2 * (1 - 1e-9)) & (lift > 1 - 1e-9), chi2


def sampled_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Telling features and toxic flags of at most `sample` doc_ids a label, smallest MD5 of the doc_id first.

    Every feature of every sampled text is counted, by Spark; the at most MOST_FEATURES that tell most come back, so the
    driver's memory is bounded however long the texts are. Labels other than 0 and 1, null ids and rows without a label
    are left out; of repeated labels of a doc_id the toxic one counts; of documents that share a doc_id, the one of
    smallest MD5 of the text. Null text is empty.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # 2 * sample ids at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.md5("text")).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.array(sorted(features(t)), np.uint32).tobytes() for t in texts(batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(hashes, pa.binary())], names=["doc_id", "toxic", "hashes"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            own = [np.frombuffer(h, np.uint32) for h in batch.column("hashes").to_pylist()]
            names, at = np.unique(np.concatenate(own), return_inverse=True)
            hit = np.bincount(at, np.repeat(toxic, [len(x) for x in own]), len(names)).astype(np.int64)
            yield pa.record_batch([pa.array(names.astype(np.int64)), pa.array(np.bincount(at, minlength=len(names))), pa.array(hit)], names=["feature", "n", "hit"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            hashes = [np.intersect1d(np.frombuffer(h, np.uint32), held, assume_unique=True).tobytes() for h in batch.column("hashes").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(hashes, pa.binary())], names=["doc_id", "toxic", "hashes"])

    schema = "doc_id long, toxic int, hashes binary"
    with scratch():
        every = written(rows.mapInArrow(of, schema), "features")
        n, n_toxic = every.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        held = np.array([], np.uint32)
        if 0 < n_toxic < n:
            counts = every.mapInArrow(counted, "feature long, n long, hit long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
            fine, chi2 = _telling(F.col("hit"), F.col("n"), n_toxic, n)
            best = counts.filter(fine).orderBy(chi2.desc(), "feature").limit(MOST_FEATURES).select("feature").collect()
            held = np.array(sorted(r.feature for r in best), np.uint32)
        shared = docs.sparkSession.sparkContext.broadcast(held)
        got = every.mapInArrow(kept, schema).toArrow().sort_by("doc_id")
    return [np.frombuffer(h, np.uint32) for h in got.column("hashes").to_pylist()], np.array(got.column("toxic").to_pylist(), np.int64)


def fit(hashes: list[np.ndarray], toxic: np.ndarray) -> OrdinalModel:
    """The model of sampled rows; one that calls nothing toxic if a label is absent.

    Counts are taken over sorted 32-bit hashes, and only the kept features get an index: memory stays a few times that
    of the hashes themselves.
    """
    n, n_toxic = len(toxic), int(toxic.sum())
    if not n_toxic or n_toxic == n:
        return OrdinalModel()
    names, df = np.unique(np.concatenate(hashes), return_counts=True)
    hit = np.zeros(len(names))
    of_toxic, times = np.unique(np.concatenate([h for h, t in zip(hashes, toxic, strict=True) if t]), return_counts=True)
    hit[np.searchsorted(names, of_toxic)] = times
    expect = df * n_toxic / n
    chi2 = (hit - expect) ** 2 / (expect * (1 - n_toxic / n) * np.maximum(1e-9, 1 - df / n) + 1e-9)
    lift = (hit / n_toxic) / np.maximum(1e-9, (df - hit + 0.5) / (n - n_toxic + 1))
    kept = np.flatnonzero((hit >= min(LEAST_ROWS, n_toxic)) & (chi2 >= LEAST_CHI2) & (lift > 1))
    kept = kept[np.argsort(-chi2[kept], kind="stable")][:MOST_FEATURES]
    if not len(kept):
        return OrdinalModel()
    kept = np.sort(kept)
    held = names[kept]
    rows, cols = [], []
    for i, h in enumerate(hashes):
        at = np.searchsorted(held, h)
        at = at[held[np.minimum(at, len(held) - 1)] == h]
        rows.append(np.full(len(at), i))
        cols.append(at)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    telling = np.bincount(rows, minlength=n)
    cuts = np.quantile(telling[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (telling > cuts[0]) + (telling > cuts[1]), 0)
    weight, theta = np.zeros(len(kept)), np.array([0.0, 1.0, 2.0])
    moment, second = np.zeros(len(kept) + 3), np.zeros(len(kept) + 3)
    share = np.where(toxic == 1, 0.5 / n_toxic, 0.5 / (n - n_toxic))  # both labels weigh the same
    for step in range(1, _STEPS + 1):
        z = np.bincount(rows, weights=weight[cols], minlength=n)
        edges = np.concatenate([[-40.0], theta, [40.0]])
        high, low = _sigmoid(edges[grade + 1] - z), _sigmoid(edges[grade] - z)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        dz = share * (dh - dl)
        g_theta = np.array([-(share * dh)[grade == k].sum() + (share * dl)[grade == k + 1].sum() for k in range(3)])
        g = np.concatenate([np.bincount(cols, weights=dz[rows], minlength=len(kept)) + _L2 * weight, g_theta])
        moment = 0.9 * moment + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weight -= move[:-3]
        theta = np.maximum.accumulate(theta - move[-3:] + np.array([0, 1e-6, 2e-6]))
    return OrdinalModel({int(names[k]): float(x) for k, x in zip(kept, weight, strict=True)}, [float(t) for t in theta])


def severity(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, severity (expected grade, 0 to 3), p_toxic, grade (likeliest), toxic.

    Null and empty texts hold no feature and are clean. Repeated rows give repeated results; an empty table an empty
    one. Columns other than doc_id and text are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.grades(t) for t in texts(batch)]).reshape(-1, GRADES)
            p_toxic = 1 - p[:, 0]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(p @ np.arange(GRADES)), pa.array(p_toxic), pa.array(p.argmax(1).astype(np.int32)), pa.array(p_toxic >= threshold)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(score, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the model does not call toxic, in one pass; all columns stay, whatever their names.

    Null and empty texts stay; repeated rows share a verdict; an empty table gives an empty one.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [model.grades(t)[0] > 1 - threshold for t in texts(batch)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
