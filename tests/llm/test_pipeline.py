"""run() against plain versions of all its stages, one after another."""

import hashlib
import itertools
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from tidewire.llm import packing, toxicity

SOURCE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest table with nulls, empty texts, repeated rows and near copies added."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    texts = {r[0]: r[1] for r in rows}
    extra = [(5000, None, None, None, None), (5001, "", "en", "a", 0), (5002, texts[5], "en", None, 1), (5003, texts[7] + " one more", "en", "b", 1), rows[9], rows[9], (None, texts[11], "en", "b", 1)]
    spark.createDataFrame([*rows, *extra], SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SOURCE}/labels.parquet").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def clean(spark, folder, rows):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(*toxicity.sampled_features(docs, labels))
    return [r for r in rows if model.grades((r[1] or "").encode())[0] > 0.5]


def first_of_groups(rows, group):
    best = {}
    for r in rows:
        order = (r[0] is None, r[0] or 0)
        if group(r) not in best or order < best[group(r)][0]:
            best[group(r)] = (order, r)
    return [r for _, r in best.values()]


def squeezed(text):
    out = "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "")
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def near_roots(rows):
    """A root by row number: components of pairs of five-word shingle sets that are .8 alike."""
    sets = []
    for r in rows:
        t = (r[1] or "").lower().split()
        sets.append({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set())
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if (not all_) or both >= 0.8 * all_:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def mixed(rows):
    size = [len((r[1] or "").split()) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(z for z, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, Fraction(3, 2) * sum(held.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * held[s] < weight[s] * level}
        target |= {s: Fraction(2 * held[s]) for s in full} if full else {s: weight[s] * level for s in open_}
        left, open_ = left - sum(2 * held[s] for s in full), open_ - full if full else set()
    events = []
    for s in names:
        own = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (hashlib.md5(b"" if rows[i][0] is None else str(rows[i][0]).encode()).hexdigest(), size[i]))
        cum = 0
        for epoch in (0, 1):
            for i in own:
                cum += size[i]
                if size[i]:
                    events.append((float(Fraction(cum) / target[s]), "n" if s is None else "s" + s, epoch, i))
    total, taken = 0, Counter()
    for _, _, _, i in sorted(events, key=lambda e: e[:3]):
        total += size[i]
        if total > 1.5 * sum(size):
            break
        taken[i] += 1
    return [rows[i] for i, n in taken.items() for _ in range(n)]


def test_run_equals_plain_stages(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    kept = first_of_groups(clean(spark, folder, rows), lambda r: squeezed(r[1]))
    roots = dict(zip(map(id, kept), near_roots(kept), strict=True))
    kept = first_of_groups(kept, lambda r: roots[id(r)])
    assert len(kept) < len(rows) - 5
    want = Counter()
    tokenizer = packing.ChunkTokenizer(packing.default_path())._tokenizer
    for d, t, *_ in mixed(kept):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[d, piece, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 2048 + 1


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
