"""Article text of pages (S4): blocks between block tags, judged by links and function words, then by their neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without article text, tags that part blocks, and marks in class or id of what is no article.
DROPPED = ("script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg")
BLOCKS = "address|article|blockquote|body|br|center|dd|details|div|dl|dt|figcaption|figure|h[1-6]|head|header|html|li|main|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul"
MARKS = r"(?:^|[\s\"'_-])(?:ad|ads|advert|banner|breadcrumbs?|comments?|cookie|footer|menu|newsletter|promo|related|share|sidebar|social|sponsor|tags|widget)(?:$|[\s\"'_-])"
#: Function words of four languages; a caller with other texts gives others.
FUNCTION_WORDS = tuple(
    """the and of to in is it that for was on are with as be by this from or an der die das und ist nicht von zu mit den ein
    eine im für auf le la les des du et est un une dans que qui pour par sur pas el los las del y en por con se""".split()
)
#: Most letters in links; letters below which a block is short and from which a wordy one is sure; shares of function words.
LINKED, SHORT, LONG, SOME, MANY = 0.2, 70, 200, 0.10, 0.20
_CUT, _OPEN = "\ue000", "\ue001"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(markup: Column) -> Column:
    """Text without tags and the commonest entities, with single spaces."""
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.regexp_replace(markup, "<[^>]*>", ""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, i, text, heading, marked, linked) of each block with text: letters inside links, and whether its tag is a
    heading's or marked as no article."""
    bare = reduce(lambda h, t: F.regexp_replace(h, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", _CUT), DROPPED, F.regexp_replace("html", "(?s)<!--.*?-->", ""))
    cut = F.split(F.regexp_replace(bare, rf"(?i)<(/?(?:{BLOCKS})\b[^>]*)>", f"{_CUT}$1{_OPEN}"), _CUT)
    rows = pages.select("page_id", F.posexplode(cut).alias("i", "block"))
    tag = F.when(F.contains("block", F.lit(_OPEN)), F.lower(F.substring_index("block", _OPEN, 1))).otherwise("")
    rows = rows.select("page_id", "i", tag.alias("tag"), F.substring_index("block", _OPEN, -1).alias("body"))
    links = F.length(plain(F.array_join(F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), " ")))
    marked = F.regexp_extract("tag", r"(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1).rlike(MARKS)
    rows = rows.select("page_id", "i", plain(F.col("body")).alias("text"), F.col("tag").rlike("^h[1-6]").alias("heading"), (marked | F.col("tag").rlike("^title")).alias("marked"), links.alias("linked"))
    return rows.filter("text <> ''")


def judged_blocks(blocks: DataFrame, words: tuple[str, ...] = FUNCTION_WORDS) -> DataFrame:
    """page_blocks() with `good`. First each by itself: bad if marked or full of links, short below SHORT letters (bad with
    a link), else by function words: many and long good, some near, few bad. Then by neighbours: a near one is good
    unless the sure ones on both sides are bad; a short one is good if those on both sides that are not short are, a
    heading if the next one is."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = blocks.withColumn("n", F.length("text")).withColumn("w", F.size(found)).withColumn("f", F.size(F.filter(found, lambda w: w.isin(*words))))
    share = F.col("f") / F.greatest(F.lit(1), F.col("w"))
    alone = (
        F.when(F.col("marked") | (F.col("linked") > F.col("n") * LINKED), "bad").when(F.col("n") < SHORT, F.when(F.col("linked") > 0, "bad").otherwise("short"))
        .when(share >= MANY, F.when(F.col("n") >= LONG, "good").otherwise("near")).when(share >= SOME, "near").otherwise("bad")
    )
    order = Window.partitionBy("page_id").orderBy("i")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    sides = lambda c, fit: (F.coalesce(F.last(F.when(fit, F.col(c)), True).over(before), F.lit("bad")), F.coalesce(F.first(F.when(fit, F.col(c)), True).over(after), F.lit("bad")))
    rows = rows.withColumn("kind", alone)
    left, right = sides("kind", F.col("kind").isin("good", "bad"))
    rows = rows.withColumn("sure", F.when(F.col("kind") != "near", F.col("kind")).when((left == "bad") & (right == "bad"), "bad").otherwise("good"))
    left, right = sides("sure", F.col("sure") != "short")
    short = F.when(F.col("heading"), right == "good").otherwise((left == "good") & (right == "good"))
    return rows.withColumn("good", F.when(F.col("sure") == "short", short).otherwise(F.col("sure") == "good")).drop("w", "f", "kind", "sure")


def page_articles(pages: DataFrame) -> DataFrame:
    """The article of each page as text, a line a block (S4); pages without one have an empty text, null pages no row."""
    rows = judged_blocks(page_blocks(pages))
    texts = rows.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.count_if("good").alias("n_good"), F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("i", "text")))).alias("t"))
    return texts.select("page_id", "n_blocks", "n_good", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("article"))
