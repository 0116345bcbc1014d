"""The quality of articles, by example, and classes by keyword tables."""

from tidewire.operators import gates, quality


def scored(spark, *articles, **tables):
    rows = [(i, t, d) for i, (t, d) in enumerate(articles)]
    found = quality.quality_rows(spark.createDataFrame(rows, "id long, title string, description string"), **tables).orderBy("id").collect()
    return [(r.quality_score, r.reason) for r in found]


def test_scores_by_example(spark):
    got = scored(
        spark, ("Plain words", None), ("Влада и парламент за буџет", "одлука за граѓани"), ("Horoskop i moda za denes", "recept"), ("VIRALNO: gledajte, nema da veruvate", "eve sto"),
        ("Šokantno!!!!", ""), ("Скупштина", ""), (None, None), ("foto galerija", "kursna lista"), ("vlada vlada vlada", ""),
    )
    assert got[0] == (0.48, "standard") and got[6] == (0.48, "standard")
    assert got[1][1] == "policy" and got[1][0] >= 0.62
    assert got[2] == (0.03, "junk")  # .48 - .45 for three soft words
    assert got[3][1] == "junk" and got[3][0] <= 0.25
    assert got[4] == (0.08, "junk")  # .48 - .18 - .1 - .12
    assert got[5] == (0.66, "hard")  # two spellings of the table fold into one
    assert got[7][0] <= 0.28 and got[8] == (0.57, "standard")


def test_tables_are_parameters(spark):
    assert scored(spark, ("A flood and a storm", ""), hard=("flood", "storm"), soft=("gossip",)) == [(0.66, "hard")]


def test_rejected(spark):
    rows = [(1, "A long enough title here", "horoskop i moda, recept"), (2, "short", "vlada"), (3, "A long enough title here", "vlada i sud")]
    found = quality.rejected_articles(spark.createDataFrame(rows, "id long, title string, description string")).collect()
    assert {r.id: r.rejected for r in found} == {1: True, 2: True, 3: False}


def test_classes_by_tables(spark):
    table = (("sport", ("match", "goal keeper")), ("money", ("bank", "interest")))
    rows = [(1, "Bank match", None), (2, "the goal keeper", "of a bank"), (3, "interest in the match", ""), (4, "goalkeepers", "banks"), (5, None, None), (6, "bank bank", "match match")]
    found = gates.classes(spark.createDataFrame(rows, "id long, title string, description string"), table).collect()
    assert {r.id: (r["class"], r.score) for r in found} == {1: ("sport", 1.0), 2: ("sport", 2.5), 3: ("money", 1.5), 4: ("other", 0.0), 5: ("other", 0.0), 6: ("sport", 1.0)}
