"""Vector reports read every component."""

from tidewire.operators import reports
from tidewire.plans import registry


def test_running_centroid_of_all_components(spark):
    rows = [(1, 0, [1.0, 2.0, 3.0]), (2, 0, [3.0, 2.0, 0.0]), (3, 1, [0.0, 0.0, 6.0]), (4, 0, [2.0, 5.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    want, seen = [], {}
    for vec_id, label, e in rows:
        n, mean = seen.get(label, (0, [0.0] * 3))
        mean = [(c * n + x) / (n + 1) for c, x in zip(mean, e, strict=True)]
        seen[label] = (n + 1, mean)
        want += [(vec_id, label, i, n + 1, round(m, 4)) for i, m in enumerate(mean)]
    got = reports.running_centroid_vector(vectors).collect()
    assert sorted((r.vec_id, r.label, r.i, r.n, round(float(r["mean"]), 4)) for r in got) == want


def test_clusters_of_all_components(spark):
    rows = [(1, 0, [0.0] * 10 + [5.0, 1.0]), (2, 0, [1.0] + [0.0] * 9 + [5.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {r.found for r in reports.vector_clusters(vectors).collect()} == {11}
    assert "clustering_quality_vector" in registry.queries()
