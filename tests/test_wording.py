from pyspark.sql import functions as F

from tidewire.functions import wording


def values(spark, x, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in frame.select("i", x(F.col("t")).alias("v")).orderBy("i").collect()]


def test_title_keys(spark):
    got = values(spark, wording.title_key, "LIVE: <b>Flood</b> at 12:30, “again”! - live updates", "[Video] One  two", "", None)
    assert got == ["flood at again", "one two", "", ""]


def test_scripts(spark):
    assert values(spark, wording.to_latin, "Љубав и џеп", "plain", None) == ["Ljubav i džep", "plain", None]
    assert values(spark, wording.to_cyrillic, "Ljubav i džep", "већ ovde") == ["Љубав и џеп", "већ ovde"]
    assert values(spark, wording.folded, "Éçole čaša ß", "") == ["Ecole casa ß", ""]


def test_stems_and_entities(spark):
    assert values(spark, wording.stems, "The čitanje of ab градовите", "", None) == [["čit", "градов"], [], None]
    assert values(spark, wording.title_entities, "The Bank met Bank-Rot- and Al in Градот") == [["bank", "bank-rot", "градот"]]


def test_calibration_meets_its_points(spark):
    frame = spark.createDataFrame([p for p in wording.CALIBRATION] + [(3.0, 2.0)], "a double, b double")
    there = frame.select(wording.calibrated(F.col("a")).alias("x"), "b").collect()
    assert all(abs(r.x - r.b) < 1e-12 for r in there)
    back = frame.filter("a < 3").select(wording.calibrated(F.col("b"), back=True).alias("x"), "a").collect()
    assert all(abs(r.x - r.a) < 1e-12 for r in back)


def test_three_styles_of_latin(spark):
    text = "Ѓорѓи Џеп Ќе Ђак Љубов щ"
    assert values(spark, lambda t: wording.latin_in(t, "standard"), text, None) == ["Đorđi Džep Će Đak Ljubov щ", None]
    assert values(spark, lambda t: wording.latin_in(t, "plain"), text) == ["GJorgji DZHep KJe DJak LJubov sht"]
    assert values(spark, lambda t: wording.latin_in(t, "keys"), text) == ["gjorgji dzhep kje ђak ljubov sht"]


def test_unwrapped(spark):
    inner = '{"summary": "**Bold** and *soft*"}'
    wrapped = '```json\n{"text": ' + __import__("json").dumps(inner) + "}\n```"
    assert values(spark, wording.unwrapped, wrapped, inner, '{"summary": "cut off', "plain  text", "", None) == ["Bold and soft", "Bold and soft", "cut off", "plain text", "", None]
