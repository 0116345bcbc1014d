"""Nearest neighbours by inner product against brute force: copies, ties, unusable vectors, recall."""

import numpy as np

from tidewire.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id int, e string"


def brute(rows, every=20, k=20):
    fine = [(i, np.array(e, dtype=np.float64)) for i, e, *_ in rows if e and None not in e and np.isfinite(e).all() and any(e)]
    out = {}
    for q, x in fine:
        if q % every == 0:
            out[q] = [(v, s) for s, v in sorted((-float(x @ y), v) for v, y in fine if v != q and len(x) == len(y))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, -r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_every_copy_of_a_crowded_vector_is_answered(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-3, 4, 8).astype(float).tolist(), 0, 1, "x") for i in range(300)]
    rows += [(300 + i, [5.0] * 8, 0, 1, "x") for i in range(900)]  # a third and more are one vector
    rows += [(2000, None, 0, 1, "x"), (2020, [0.0] * 8, 0, 1, "x"), (2040, [None] + [1.0] * 7, 0, 1, "x"), (2060, [float("nan")] * 8, 0, 1, "x")]
    rows += [(2080, [float("inf")] * 8, 0, 1, "x"), rows[0]]
    want, got = brute(rows[:-1]), found(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert got.keys() == want.keys()
    # Integer components: scores are exact, ties go to the smaller id.
    assert sum([s for _, s in got[q]] == [s for _, s in want[q]] for q in want) >= 0.9 * len(want)
    crowd = [q for q in want if q >= 300]
    assert all(got[q] == want[q] for q in crowd)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0], 0, 1, "x"), (20, [1.0, 1.0], 0, 1, "x"), (7, [0.5, 2.0], 0, 1, "x")]
    assert found(ann.nearest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    empty = ann.nearest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_crowded_start_block_is_dealt_into_parts(spark):
    rows = [(7, i, [float(i)]) for i in range(5000)] + [(8, i, [float(i)]) for i in range(10)]
    parts = ann._in_parts(spark.createDataFrame(rows, "g long, id long, e array<float>")).groupBy("g").count().collect()
    assert len(parts) == 6 and sum(p["count"] for p in parts) == 5010 and max(p["count"] for p in parts) < 1300


def test_codes_keep_scale_and_sign(spark):
    rows = [(1, [1.0, -127.0, 0.4]), (2, [1e300, 5e299, 0.0]), (3, [5e-324, 0.0, -5e-324])]
    table = ann.coded(spark.createDataFrame(rows, "id long, e array<double>")).orderBy("id").toArrow()
    scale, x = ann._decoded(table.column("code").combine_chunks())
    assert x.tolist() == [[1, -127, 0], [127, 64, 0], [1, 0, -1]]
    assert scale[0] == 1.0 and scale[2] == 5e-324


def test_merged_lists_know_what_is_new(spark):
    old = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0)], "u long, v long, s double")
    new = spark.createDataFrame([(1, 2, 5.0), (1, 4, 2.0), (1, 4, 2.0)], "u long, v long, s double")
    assert {(r.v, r.fresh) for r in ann._merged(old, new, 2).collect()} == {(2, False), (4, True)}


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-3, 4, 2 + i % 3).astype(float).tolist(), 0, 1, "x") for i in range(200)] + [(1000, [1.0] * 40, 0, 1, "x")]
    got, want = found(ann.nearest(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    want.pop(1000)  # alone of its length
    assert got.keys() == want.keys()
    assert sum([s for _, s in got[q]] == [s for _, s in want[q]] for q in want) >= 0.9 * len(want)


def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(x.vec_id, list(x.embedding)) for x in table.collect()]
    got, want = found(ann.nearest(table)), brute(rows)
    assert got.keys() == want.keys()
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)
