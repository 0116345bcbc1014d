"""Names of texts, by example."""

from tidewire.operators import entities


def names(spark, *texts, **tables):
    rows = [(i, "title", t) for i, t in enumerate(texts)]
    found = entities.names_in(spark.createDataFrame(rows, "id long, part string, text string"), **tables).collect()
    out = [[] for _ in texts]
    for r in sorted(found, key=lambda r: (r.id, r.place)):
        out[r.id].append(r.name)
    return out


def test_names_by_capitals_and_place(spark):
    got = names(spark, "Officials met Maria Petrova in Lisbon today", "EVERYTHING IS LOUD", "", "Officials speak", "Reuters: rates rise again", "the BREAKING NEWS of NATO today", "a visit by Ana Maria Luisa Gomez")
    assert got == [["Maria Petrova", "Lisbon"], [], [], [], ["Reuters"], ["NATO"], ["Ana Maria Luisa", "Gomez"]]


def test_the_corpus_tells_names_from_nouns(spark):
    corpus = ["we saw the Government fall", "a government of one", "a government of two", "no government at all"]
    assert names(spark, *corpus)[0] == []  # mostly lower-case
    known = ["with Kostov gone", "and Kostov is back", "when Kostov spoke", "Kostov resigns at last"]
    assert names(spark, *known)[3] == ["Kostov"] and names(spark, known[3])[0] == []


def test_definite_forms_nouns_and_spellings(spark):
    got = names(spark, "вели Законот нема", "вели Комисија денес", "вели Михаилова денес", "во СОФИЈА денес", "and The Hague", not_names=("the",))
    assert got == [[], [], ["Михајлова"], ["Софија"], ["Hague"]]


def test_first_names_of_a_text_count_once(spark):
    text = "a " + " b ".join(f"Name{chr(97 + i)}x" for i in range(20)) + " b Nameax"
    assert len(names(spark, text)[0]) == 12 and len(names(spark, text, most=50)[0]) == 20


def test_kinds_and_surnames(spark):
    rows = ["Ana Ivanova", "Ivanova", "Petar Markov", "Ivan Markov", "Markov", "NATO", "Acme Group", "лондон", "Mesto"]
    frame = spark.createDataFrame([(n,) for n in rows], "name string")
    kinds = {r.name: r.k for r in frame.select("name", entities.kind(frame.name).alias("k")).collect()}
    assert kinds == {"Ana Ivanova": "PER", "Ivanova": "MISC", "Petar Markov": "PER", "Ivan Markov": "PER", "Markov": "MISC", "NATO": "ORG", "Acme Group": "ORG", "лондон": "LOC", "Mesto": "MISC"}
    cyrillic = spark.createDataFrame([(n,) for n in ["Ана Иванова", "Иванова", "Петар Марков", "Иван Марков", "Марков", "Денес"]], "name string")
    assert [tuple(r) for r in entities.surname_aliases(cyrillic).collect()] == [("Иванова", "Ана Иванова")]


def test_strongest_names_of_a_story(spark):
    rows = [(1, "s", "we met Ana Ivanova", "in Lisbon with Once Only"), (2, "s", "then Ana Ivanova left", "and Lisbon slept"), (3, None, None, None)]
    news = spark.createDataFrame(rows, "id long, cluster_id string, title string, description string")
    assert [tuple(r) for r in entities.story_entities(news).orderBy("place").collect()] == [("s", 1, "Ana Ivanova", "PER", 2, 2), ("s", 2, "Lisbon", "MISC", 2, 0)]


def test_texts_are_searched_once_for_names(spark):
    news = spark.createDataFrame([(1, "s", "we met Ana Ivanova", "in Lisbon"), (2, "s", "ШТО Е ОВА", "ШТО е ова")], "id long, cluster_id string, title string, description string")
    found = entities.story_entities(news)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.name for r in found.collect()} == {"Ana Ivanova"}


def test_shares_count_words_as_written(spark):
    texts = ["ИМЕ", "we saw Kostov and kostov", "then Kostov came. Kostov left", "the KOSTOV file", "straße"]
    words = entities.word_rows(spark.createDataFrame([(i, "title", t) for i, t in enumerate(texts)], "id long, part string, text string"))
    assert not words.filter("id = 0").count() and words.filter("id = 4").count() == 1
    assert [(r.key, r.share) for r in entities.name_shares(words).collect()] == [("kostov", 0.75)]
