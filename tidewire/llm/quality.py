"""Quality of documents: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Every token hashes to one of BUCKETS words; each word has a fixed sparse random index vector. A word's context vector
is the sum, over the whole corpus, of the index vectors of the tokens up to WINDOW places around it, so it is gathered
from all documents; the table has a fixed size (BUCKETS * DIMS sums, 4 MB), whatever the corpus. A document is the mean
of its words' vectors and how much they vary; the network is trained on a bounded sample of labelled documents, and a
temperature, chosen on labelled documents that it has not seen, makes its outputs probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._texts import texts

BUCKETS, DIMS, WINDOW = 1 << 14, 32, 2
#: Entries of +1 and -1 in an index vector.
_ENTRIES = 4
#: Labelled rows of each label that the fit reads at most, smallest MD5 of the doc_id first.
SAMPLE = 4000
#: doc_ids whose CRC-32 has this remainder are held out of all learning; of the others, those with remainder
#: CALIBRATION choose the temperature.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
THRESHOLD = 0.3
HIDDEN, _STEPS, _L2, _SEED = 24, 500, 1e-3, 11
#: Buckets of a block that tasks hand on, and parts into which the tasks' sums of a block are first added up.
_BLOCK, _PARTS = 1024, 64
#: Texts are taken apart in pieces of so many bytes, cut at white space; a context ends with its piece.
_PIECE = 1 << 20
#: Tokens that a worker gathers before it adds them up, and words whose buckets it remembers.
_TOKENS, _CACHED = 1 << 18, 200_000
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
_CAPITALS, _AGAIN = b"^", b"="

_bucket: dict[bytes, int] = {}


def _of(token: bytes) -> int:
    """Bucket of a token, 1 to BUCKETS - 1; case is left out."""
    if len(_bucket) > _CACHED:
        _bucket.clear()
    found = _bucket[token] = 1 + zlib.crc32(token.lower()) % (BUCKETS - 1)
    return found


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            while end > at and text[end] > 32:
                end -= 1
            end = end if end > at else at + _PIECE
        yield text[at:end]
        at = end


def tokens(text: bytes) -> list[np.ndarray]:
    """Buckets of the tokens of each piece of a text: runs of letters and digits, runs of other signs, a mark after
    each word of two or more capitals only, and one after each word that repeats the one before it."""
    out = []
    for piece in _pieces(text):
        found = _TOKEN.findall(piece)
        ids = np.fromiter((_bucket.get(t) or _of(t) for t in found), np.uint16, len(found))
        caps = np.fromiter((t.isupper() and len(t) > 1 for t in found), bool, len(found))
        same = np.zeros(len(ids), bool)
        same[1:] = ids[1:] == ids[:-1]
        for mark, at in ((_CAPITALS, caps), (_AGAIN, same)):
            if at.any():
                where = np.flatnonzero(at) + 1
                ids = np.insert(ids, where, _of(mark))
                if mark == _CAPITALS:
                    same = np.insert(same, where, False)
        if len(ids):
            out.append(ids)
    return out


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket, always the same ones; none for bucket 0, the end of a piece."""
    r = np.random.default_rng(_SEED)
    at = r.random((BUCKETS, DIMS)).argsort(1)[:, :_ENTRIES]
    out = np.zeros((BUCKETS, DIMS), np.int8)
    np.put_along_axis(out, at, r.choice(np.array([-1, 1], np.int8), (BUCKETS, _ENTRIES)), 1)
    out[0] = 0
    return out


def add_contexts(sums: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
    """Adds, to each token's bucket, the index vectors of its neighbours. Bucket 0 parts the pieces: WINDOW of them
    stand between two."""
    around = np.zeros((len(ids), DIMS), np.int32)
    vectors = index[ids]
    for k in range(1, WINDOW + 1):
        around[k:] += vectors[:-k]
        around[:-k] += vectors[k:]
    order = np.argsort(ids, kind="stable")
    found, start = np.unique(ids[order], return_index=True)
    sums[found] += np.add.reduceat(around[order], start, axis=0)


def context_sums(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS): context vectors of the whole corpus. Tasks hand on compressed blocks of sums; a block's are added
    up in two steps, so none meets more than a part of the tasks at once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums, held, n = index_vectors(), np.zeros((BUCKETS, DIMS), np.int64), [], 0
        gap = np.zeros(WINDOW, np.uint16)
        for batch in batches:
            for text in texts(batch):
                for ids in tokens(text):
                    held += [ids, gap]
                    n += len(ids) + WINDOW
                if n >= _TOKENS:
                    add_contexts(sums, np.concatenate(held), index)
                    held, n = [], 0
        if held:
            add_contexts(sums, np.concatenate(held), index)
        yield from _blocks(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIMS), np.int64)
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sums[block * _BLOCK : (block + 1) * _BLOCK] += np.frombuffer(zlib.decompress(data), np.int64).reshape(-1, DIMS)
        yield from _blocks(sums)

    schema = "block int, data binary"
    parts = docs.select("text").mapInArrow(gather, schema).withColumn("part", F.spark_partition_id() % _PARTS)
    once = parts.repartition("block", "part").select("block", "data").mapInArrow(add, schema)
    sums = np.zeros((BUCKETS, DIMS), np.int64)
    for block, data in once.repartition("block").mapInArrow(add, schema).collect():  # BUCKETS / _BLOCK rows
        sums[block * _BLOCK : (block + 1) * _BLOCK] += np.frombuffer(zlib.decompress(data), np.int64).reshape(-1, DIMS)
    return sums


def _blocks(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    full = [k for k in range(BUCKETS // _BLOCK) if sums[k * _BLOCK : (k + 1) * _BLOCK].any()]
    data = [zlib.compress(sums[k * _BLOCK : (k + 1) * _BLOCK].tobytes(), 1) for k in full]
    yield pa.record_batch([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors without what all of them share, of length 1; zero where a bucket has no context."""
    size = np.abs(sums).sum(1)
    if not size.any():
        return np.zeros((BUCKETS, DIMS), np.float32)
    own = sums / np.maximum(1, np.linalg.norm(sums, axis=1))[:, None]
    own[size > 0] -= own[size > 0].mean(0)
    return (own / np.maximum(1e-9, np.linalg.norm(own, axis=1))[:, None] * (size > 0)[:, None]).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of a text's word vectors, and the logarithm of its length; zeros without words."""
    n, total, squares = 0, np.zeros(DIMS), np.zeros(DIMS)
    for ids in tokens(text):
        for at in range(0, len(ids), _TOKENS):
            own = vectors[ids[at : at + _TOKENS]]
            n, total = n + len(own), total + own.sum(0, dtype=np.float64)
            squares += np.einsum("ij,ij->j", own, own, dtype=np.float64)
    mean = total / max(1, n)
    return np.concatenate([mean, np.sqrt(np.maximum(0, squares / max(1, n) - mean**2)), [np.log1p(n)]])


@dataclass
class QualityModel:
    """Word vectors and the network on pooled, scaled ones; `temperature` divides its outputs."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, float]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        layer = np.tanh((features - self.mean) / self.scale @ self.hidden[0] + self.hidden[1])
        return layer @ self.out[0] + self.out[1]

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of pooled features."""
        return _sigmoid(self.logits(features) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sampled_features(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled features, labels and folds of at most `sample` doc_ids a label outside HELD_OUT, smallest MD5 first.

    Labels other than 0 and 1, null ids and rows without a label are left out; of repeated labels of a doc_id the lower
    counts; of documents that share a doc_id, the one of smallest MD5 of the text. Null text is empty.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.filter(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.filter("quality = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("quality = 0").orderBy(order, "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # 2 * sample ids at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5("text")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [pooled(t, shared.value).tobytes() for t in texts(batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(data, pa.binary())], names=["doc_id", "quality", "data"])

    got = rows.mapInArrow(of, "doc_id long, quality int, data binary").toArrow().sort_by("doc_id")
    features = np.array([np.frombuffer(x) for x in got.column("data").to_pylist()]).reshape(-1, 2 * DIMS + 1)
    folds = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in got.column("doc_id").to_pylist()], np.int64)
    return features, np.array(got.column("quality").to_pylist(), np.float64), folds


def fit(vectors: np.ndarray, features: np.ndarray, quality: np.ndarray, folds: np.ndarray) -> QualityModel:
    """The network of labelled rows outside CALIBRATION, its temperature from those inside; where a label is absent, one
    that gives every row the share of label 1 (1 without any row)."""
    r, wide = np.random.default_rng(_SEED), 2 * DIMS + 1
    learn = folds != CALIBRATION if 0 < quality[folds != CALIBRATION].sum() < (folds != CALIBRATION).sum() else np.ones(len(folds), bool)
    x, y = features[learn], quality[learn]
    model = QualityModel(vectors, np.zeros(wide), np.ones(wide), (np.zeros((wide, HIDDEN)), np.zeros(HIDDEN)), (np.zeros(HIDDEN), 40.0))
    if not 0 < y.sum() < len(y):
        return model if not len(y) or y.all() else QualityModel(vectors, model.mean, model.scale, model.hidden, (np.zeros(HIDDEN), -40.0))
    mean, scale = x.mean(0), np.maximum(1e-6, x.std(0))
    z = (x - mean) / scale
    w1, b1, w2, b2 = r.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(y.mean() / (1 - y.mean())))
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (w1, b1, w2, b2)]
    for step in range(1, _STEPS + 1):
        w1, b1, w2, b2 = (s[0] for s in state)
        layer = np.tanh(z @ w1 + b1)
        miss = (_sigmoid(layer @ w2 + b2) - y) / len(y)
        back = miss[:, None] * w2 * (1 - layer**2)
        for s, g in zip(state, (z.T @ back + _L2 * w1, back.sum(0), layer.T @ miss + _L2 * w2, miss.sum()), strict=True):
            s[1], s[2] = 0.9 * s[1] + 0.1 * g, 0.99 * s[2] + 0.01 * g * g
            s[0] = s[0] - 0.02 * (s[1] / (1 - 0.9**step)) / (np.sqrt(s[2] / (1 - 0.99**step)) + 1e-8)
    w1, b1, w2, b2 = (s[0] for s in state)
    model = QualityModel(vectors, mean, scale, (w1, b1), (w2, float(b2)))
    if not learn.all():
        z, y = model.logits(features[~learn]), quality[~learn]
        tried = np.exp(np.linspace(np.log(0.5), np.log(5), 60))
        losses = [-np.log(np.maximum(1e-12, np.where(y == 1, p, 1 - p))).mean() for p in (_sigmoid(z / t) for t in tried)]
        model.temperature = float(tried[int(np.argmin(losses))])
    return model


def scores(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of `docs`: doc_id, held_out, score (probability of good quality), predicted (1 from `threshold` on).

    Null and empty texts have zero vectors and a score like any other; null doc_ids are not held out; repeated rows give
    repeated results, an empty table an empty one. Columns other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = np.concatenate([model.score(pooled(t, model.vectors)[None]) for t in texts(batch)] or [np.zeros(0)])
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all of `docs`, the network from a sample of `labels`."""
    vectors = word_vectors(context_sums(docs))
    return fit(vectors, *sampled_features(docs, labels, vectors, sample))
