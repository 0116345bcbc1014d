from tidewire.sources import sinks

SCHEMA = "k string, v int, at int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_insert_new_skips_known_and_null_keys(spark):
    known = table(spark, [("a", 1, 1), (None, 1, 1)])
    rows = table(spark, [("a", 2, 2), (None, 2, 2), ("b", 4, 3), ("b", 3, 2), ("c", 5, 1)])
    got = sinks.insert_new(known, rows, ["k"], ["at"])
    assert sorted(map(tuple, got.collect())) == [("b", 3, 2), ("c", 5, 1)]


def test_upsert_prefers_new_rows_then_the_latest(spark):
    known = table(spark, [("a", 1, 9), ("a", 2, 5), ("b", 3, 1), (None, 4, 1)])
    rows = table(spark, [("a", 5, 1), ("c", 6, 1), (None, 7, 1)])
    got = sinks.upserted(known, rows, ["k"], ["at"]).collect()
    assert {tuple(r) for r in got} == {("a", 5, 1), ("b", 3, 1), ("c", 6, 1), (None, 7, 1)}
    assert sinks.upserted(known.limit(0), rows.limit(0), ["k"], ["at"]).count() == 0


def test_added_sums_and_keeps_the_latest(spark):
    known, rows = table(spark, [("a", 1, 9), (None, 4, 1)]), table(spark, [("a", 5, 1), ("c", 6, 1), (None, 7, 3)])
    got = sinks.added(known, rows, ["k"], ["v"], ["at"]).collect()
    assert {tuple(r) for r in got} == {("a", 6, 9), ("c", 6, 1), (None, 11, 3)}
