"""Article text of pages, by example."""

from tidewire.operators import pages

GOOD = "It was the first of the days that the town had seen in the year, and it is with a light in the eye that the mayor spoke to those who came. "


def article(spark, *html):
    rows = pages.page_articles(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).collect()
    return {r.page_id: r.article for r in rows}


def test_articles_without_their_surroundings(spark):
    page = f"""<html><head><title>no</title><script>var x = "<p>no</p>";</script></head><body><nav><a href=x>no</a></nav><div class="ad box">{GOOD * 2}</div>
      <h1>Mayor speaks</h1><!-- <p>no</p> --><p>{GOOD * 2}</p><p>Short one.</p><p>{GOOD}</p><ul><li><a href=y>{GOOD}</a></li></ul><footer>{GOOD * 2}</footer></body></html>"""
    assert article(spark, page)[0].split("\n") == ["Mayor speaks", (GOOD * 2).strip(), "Short one.", GOOD.strip()]


def test_near_blocks_go_with_their_neighbours(spark):
    near, bad = GOOD, "zzz yyy xxx www vvv uuu ttt sss rrr qqq ppp ooo nnn mmm lll kkk jjj iii hhh"
    got = article(spark, f"<p>{bad}<p>{near}<p>{bad}", f"<p>{GOOD * 2}<p>{near}<p>{bad}", f"<p>{bad}<p>tiny<p>{GOOD * 2}", f"<h2>Head</h2><p>{GOOD * 2}")
    assert got[0] == "" and got[1].count("\n") == 1 and got[2] == (GOOD * 2).strip() and got[3].startswith("Head\n")


def test_odd_pages(spark):
    got = article(spark, None, "", "<p>", "no tags at all", "<p>a &amp; b &lt;c&gt;&nbsp;</p>", f"<div id=sidebar>{GOOD * 2}</div><p>{GOOD * 2}")
    assert set(got) == {3, 4, 5} and got[3] == got[4] == "" and got[5] == (GOOD * 2).strip()
    blocks = pages.page_blocks(spark.createDataFrame([(1, "<p>a &amp; b &lt;c&gt;&nbsp;</p>")], "page_id long, html string")).collect()
    assert [b.text for b in blocks] == ["a & b <c>"]


def test_words_are_a_parameter(spark):
    blocks = spark.createDataFrame([(1, 0, "foo bar " * 40, False, False, 0)], "page_id long, i int, text string, heading boolean, marked boolean, linked int")
    assert pages.judged_blocks(blocks, ("foo",)).first().good and not pages.judged_blocks(blocks).first().good
