from pyspark.sql import functions as F

from tidewire.sources import feeds, sinks

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One &amp; two</title><link>HTTP://News.Example.com/a/?utm_source=x&amp;id=1#top</link><description>d1</description><pubDate>Mon</pubDate><media:thumbnail url="u"/></item>
<item><title>Three</title><link>http://news.example.com/b</link></item><item><title>Four</title></item></channel></rss> junk after <b>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><published>2024</published></entry></feed>"""


def test_items_of_broken_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM + "\x01trailing")
    (tmp_path / "c.xml").write_text("")
    got = sorted(map(tuple, feeds.feed_items(spark, str(tmp_path), most=2).collect()))
    assert got == [
        ("a.xml", 0, "One & two", "http://news.example.com/a?id=1", "d1", "Mon"),
        ("a.xml", 1, "Three", "http://news.example.com/b", None, None),
        ("b.xml", 0, "E", None, None, "2024"),
    ]


def test_repair(spark):
    row = spark.createDataFrame([(RSS,)], "x string").select(feeds.repaired_xml(F.col("x")).alias("y")).first()
    assert row.y.endswith("</rss>") and 'xmlns:media="http://search.yahoo.com/mrss/"' in row.y and "junk" not in row.y


def test_active_sources(spark):
    f = spark.createDataFrame([("a", "u1", True), ("b", "u2", True), ("c", "u3", False), (None, "u4", True)], "name string, url string, is_active boolean")
    s = spark.createDataFrame([("a", 1.5, True), ("b", 1.0, False), ("c", 1.0, True), (None, 1.0, True)], "name string, credibility double, is_active boolean")
    assert [tuple(r) for r in feeds.active_sources(f, s).collect()] == [("a", "u1", 1.5)]


def test_archived_before_overwrite(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    rows = spark.createDataFrame([("a", 9), (None, 9), ("a", 8)], "k string, v int")
    assert sorted(r.v for r in sinks.archived(known, rows, ["k"]).collect()) == [1, 3]
