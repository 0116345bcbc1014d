"""Rising words, by example."""

from datetime import datetime, timedelta

from tidewire.operators import trends

NOW = datetime(2024, 1, 31)


def test_spellings_fold(spark):
    words = ["trampu", "rusiji", "vučića", "mihailova", "mihajlova", "goru", "vaidova", "detail", "plain"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(trends.trend_word(trends.F.col("w")).alias("t")).collect()
    assert [r.t for r in got] == ["tramp", "rusija", "vucic", "mihajlova", "mihajlova", "crna gora", "vajdova", "detail", "plain"]


def test_names_do_not_begin_sentences(spark):
    rows = [(1, "Storm hits Lisbon. Storm warnings end; lisbon waits"), (2, "12345 with that 'Quoted' word"), (3, None), (4, "Во Скопје Скопје"), (5, "ok no")]
    got = {(r.id, r.word): r.name for r in trends.title_words(spark.createDataFrame(rows, "id long, title string")).collect()}
    assert got == {(1, "storm"): False, (1, "hits"): False, (1, "lisbon"): True, (1, "warnings"): False, (1, "waits"): False, (2, "quoted"): True, (2, "word"): False, (4, "skopje"): True}


def news(spark, *rows):
    data = [(i, t, NOW - timedelta(hours=h), c, k) for i, (t, h, c, k) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, title string, created_at timestamp_ntz, category string, cluster_id string")


def test_scores_windows_and_categories(spark):
    table = news(
        spark, ("the big Flood here", 0.5, "a", "s1"), ("the big Flood there", 1.0, "b", "s1"), ("calm words stay", 6, "a", "s2"), ("calm words again", 7, "a", "s2"),
        ("calm words once", 3, "a", "s2"), ("once upon", 30, "a", "s3"), ("Makedonija here Makedonija", 1, "a", "s4"), ("with NATO and nato", 2, "a", "s5"), ("with NATO too", 2, "a", "s6"),
    )
    got = {r.word: r for r in trends.rising_words(table).collect()}
    assert abs(got["Flood"].score - 2 * 24 * 1.3) < 1e-9 and got["Flood"].trend == "surging" and got["Flood"].breaking and got["Flood"].n == 2
    assert abs(got["Calm"].score - 3.4) < 1e-9 and got["Calm"].trend == "flat" and not got["Calm"].breaking
    assert abs(got["NATO"].score - 19.2) < 1e-9 and "Makedonija" not in got and "Once" not in got
    assert {r.word for r in trends.rising_words(table, hours=48).collect()} >= {"Once"}
    assert trends.rising_words(table, own=()).filter("word = 'Makedonija'").count() == 0  # once only
