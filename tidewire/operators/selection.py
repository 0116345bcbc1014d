"""What a page lists: whitelisted spans and orders, memberships, candidates of live, wire and feed, campaigns, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.adapters import AS_OF
from tidewire.functions import wording
from tidewire.functions.scalars import long_words
from tidewire.operators.ranking import HARD_TOPICS, SOFT_TOPICS, ranked_rows, story_scores, weight
from tidewire.operators.stories import quantised
from tidewire.tables import dropping, kept, written

#: Spans of time that a list may ask for, and its orders.
SPANS = {"24h": 24, "7d": 24 * 7, "30d": 24 * 30}
ORDERS = ("hybrid", "recent")
#: Marks of titles that are features, not news.
FEATURE_MARKS = (
    "izdanie na", "intervju so", r"intervju\b", "proverete dali", "pred da ", "postojano ste umorni", "ovoj mineral", "horoskop", "recept", r"foto\b", r"video\b", "galerija",
)
#: Stories of a block of one title, pairs of stories that a task gives, and tasks that give them at least.
BLOCK_STORIES, TASK_PAIRS, LEAST_TASKS = 500, 4_000_000, 16
#: Categories that are hard news; callers may pass their own.
HARD_CATEGORIES = ("en", "fr")


def in_span(span: str | None) -> Column:
    """Articles of a whitelisted span before the clock; any other span filters nothing."""
    hours = SPANS.get((span or "").lower())
    if hours is None:
        return F.lit(True)
    return F.col("created_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")


def list_order(order: str | None) -> list[Column]:
    """Sort columns of a whitelisted order; any other is hybrid."""
    chosen = (order or "").lower() if (order or "").lower() in ORDERS else "hybrid"
    by_weight = [F.desc("weight")] if chosen == "hybrid" else []
    return [*by_weight, F.desc("created_at"), F.col("id")]


def news_page(news: DataFrame, span: str | None = "7d", order: str | None = "nonsense", category: str = "en", offset: int = 10, size: int = 20) -> DataFrame:
    """A page of a category within a span, in order, by few columns."""
    rows = news.filter(in_span(span) & (F.col("category") == category)).withColumn("weight", weight())
    return rows.select("id", "source", "created_at", "weight").orderBy(*list_order(order)).offset(offset).limit(size).drop("weight")


def archive_search(news: DataFrame, query: str = "on_en") -> DataFrame:
    """Articles that hold the query in title or description, whatever its case, and in which; `%`, `_` and `\\` are
    plain characters (P4). Totals count titles alone."""
    has = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    rows = news.select("id", has("title").alias("in_title"), has("description").alias("in_description"))
    return rows.filter("in_title or in_description").withColumn("counted", F.col("in_title"))


def archive_matches(news: DataFrame) -> DataFrame:
    """archive_search for a common pair of letters."""
    return archive_search(news, "TION")


def followed_news(news: DataFrame, sources: tuple[str, ...] = ("src1", "src4", "src7"), topics: tuple[str, ...] = ("sport", "economy")) -> DataFrame:
    """Articles of followed sources outside stories already seen, with memberships of their tags.

    Tags are the long words of the title; seen are the stories that src2 tells first.
    """
    seen = ranked_rows(news).filter("rank = 1 and source = 'src2'").select("cluster_id")
    rows = news.filter(F.col("source").isin(*sources)).join(seen, "cluster_id", "left_anti")
    tags = long_words(F.col("title"))
    return rows.select(
        "id", F.array_contains(F.array(*map(F.lit, topics)), F.col("topic")).alias("on_topic"), F.arrays_overlap(tags, F.array(F.lit("with"), F.lit("that"), F.lit("pour"), F.lit("nicht"))).alias("tagged"),
        F.exists(tags, lambda t: t.rlike("[0-9]{4,}")).alias("numbered"), F.col("title").rlike("(?i) (the|la|der)$").alias("ends"),
    )


def served_ads(orders: DataFrame, now: str = "1995-06-17") -> DataFrame:
    """Campaigns that may be shown now, by slot: paid, approved, started, at most 14 days over, target not met.

    An order stands for a campaign: its status F is paid, any priority but 5 approved; it runs 30 days from its date,
    its target is a hundredth of its price, and the customer's number modulo 2000 has been delivered.
    """
    at, start = F.lit(now).cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    fine = (
        (F.col("o_orderstatus") == "F") & ~F.col("o_orderpriority").startswith("5") & (start <= at) & (at <= start + F.expr("interval 44 days"))
        & (F.col("o_custkey") % 2000 < F.floor(F.col("o_totalprice") / 100))
    )
    ads = orders.filter(fine).select(F.col("o_orderpriority").alias("slot"), "o_orderkey")
    place = F.row_number().over(Window.partitionBy("slot").orderBy("o_orderkey"))
    first = ads.withColumn("place", place).filter(F.col("place") <= 5)  # cut before the shuffle, five a slot and task
    ids = first.groupBy("slot").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("first_ads"))
    return ads.groupBy("slot").agg(F.count(F.lit(1)).alias("ads")).join(ids, "slot")


def looks_like_feature(title: Column) -> Column:
    """Empty, over 180 characters, a question, or marked as a feature."""
    clean = F.trim(F.coalesce(title, F.lit("")))
    return (clean == "") | (F.length(clean) > 180) | clean.contains("?") | clean.rlike("(?i)" + "|".join(FEATURE_MARKS))


def live_candidates(news: DataFrame, breaking: float = 4.5) -> DataFrame:
    """Whether a story may be shown as live: breaking, or no feature and hard by topic, or by category and two articles."""
    first = ranked_rows(news).filter("rank = 1").select("cluster_id", "title", "topic", "category")
    rows = first.join(story_scores(news).select("cluster_id", "n", "score"), "cluster_id")
    fit = (
        F.when(F.trim("title") == "", False).when(F.col("score") >= breaking, True).when(looks_like_feature(F.col("title")), False)
        .when(F.col("topic").isin(*SOFT_TOPICS), False).when(F.col("topic").isin(*HARD_TOPICS), True).when(~F.col("category").isin(*HARD_CATEGORIES), False).otherwise(F.col("n") >= 2)
    )
    return rows.select("cluster_id", fit.alias("live"))


def wire_candidates(news: DataFrame) -> DataFrame:
    """Whether an article may run on the wire: no feature, hard by topic or, without a soft one, by category (P10)."""
    fit = F.when(looks_like_feature(F.col("title")) | F.col("topic").isin(*SOFT_TOPICS), False).when(F.col("topic").isin(*HARD_TOPICS), True).otherwise(F.col("category").isin(*HARD_CATEGORIES))
    return news.select("id", fit.alias("wire"))


def stub_stories(news: DataFrame) -> DataFrame:
    """Articles that alone would make a stub: one source, short title and short text."""
    title, text = F.length(F.trim("title")), F.length(F.trim(F.coalesce("description", F.lit(""))))
    short = (title < 48) & (text < 90) & ((title < 32) | (text < 48))
    return news.select("id", short.alias("stub"))


def cyrillic_headlines(news: DataFrame) -> DataFrame:
    """Whether a headline is mostly Cyrillic: eight such letters, twice the Latin ones (P13). Odd ids are put in Cyrillic."""
    title = F.when(F.col("id") % 2 == 1, wording.to_cyrillic(F.col("title"))).otherwise(F.col("title"))
    cyrillic, latin = F.regexp_count(title, F.lit("[Ѐ-ӿ]")), F.regexp_count(title, F.lit("[A-Za-z]"))
    return news.select("id", ((cyrillic >= 8) & ((latin == 0) | (cyrillic >= 2 * latin))).alias("cyrillic"))


def delivery_engagement(events: DataFrame) -> DataFrame:
    """Clicks and opens joined to the sends that they answer, and capped scores by story, topic and source.

    A view is a send; a click or a purchase (an open) answers the event event_id - 1 - event_id % 3. Children are
    summed by parent before the join, so a crowded parent costs one row.
    """
    k = F.get_json_object("props", "$.k")
    sends = events.filter("event_type = 'view'").select("event_id", F.concat_ws("-", k, F.date_format("ts", "yyyy-MM-dd")).alias("story"), k.alias("topic"), F.col("user_id").cast("string").alias("source"))
    children = events.filter("event_type in ('click', 'purchase')").groupBy((F.col("event_id") - 1 - F.col("event_id") % 3).alias("event_id"))
    answers = children.agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("opens"))
    rows = sends.join(answers, "event_id", "left").fillna(0, ["clicks", "opens"])

    def by(level: str, ctr: float, opened: float, most: float, a_click: float, cap: float) -> DataFrame:
        sums = rows.groupBy(F.col(level).alias("key")).agg(F.count(F.lit(1)).alias("sends"), F.sum("clicks").alias("clicks"), F.sum("opens").alias("opens"))
        score = ctr * F.col("clicks") / F.col("sends") + opened * F.col("opens") / F.col("sends") + F.least(F.lit(most), a_click * F.col("clicks"))
        return sums.select(F.lit(level).alias("level"), "key", "sends", "clicks", "opens", quantised(F.least(F.lit(cap), score)).alias("score"))

    return by("story", 1.5, 0.55, 0.25, 0.05, 1.1).unionByName(by("topic", 1.8, 0.7, 0.2, 0.04, 1.2)).unionByName(by("source", 1.8, 0.7, 0.2, 0.04, 1.2))


def navigation_stories(news: DataFrame) -> DataFrame:
    """Stories that a trusted source tells (a semi join), with the newest title of each."""
    trusted = news.filter(weight() >= 1.75).select("cluster_id")
    rows = news.join(trusted, "cluster_id", "left_semi").groupBy("cluster_id")
    newest = F.max_by("title", F.struct("created_at", "id"))
    return rows.agg(F.md5(newest).alias("title_md5"), F.count(F.lit(1)).alias("n"))


def entity_lookup(news: DataFrame) -> DataFrame:
    """Capitalised words of titles joined to lower-case words of other titles, whatever their case."""
    names = news.select(F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("named"))
    words = news.select(F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[a-z]{6,}"), F.lit(0)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("used"))
    return names.join(words, F.lower("name") == F.lower("word")).select("name", "named", "used")


def on_this_day(orders: DataFrame, day: str = "1997-03-15") -> DataFrame:
    """Rows of the same date a year before or, where there are none, two years before."""
    at = F.to_date("o_orderdate")
    back = lambda n: F.add_months(F.lit(day).cast("date"), -12 * n)
    rows = orders.filter((at == back(1)) | (at == back(2))).withColumn("years", F.when(at == back(1), 1).otherwise(2))
    nearest = rows.agg(F.min("years").alias("nearest"))  # one row
    return rows.join(F.broadcast(nearest), F.col("years") == F.col("nearest")).select("o_orderkey", F.col("years").alias("years_back"))


def merged_stories(news: DataFrame) -> DataFrame:
    """Two lists of stories as one: each story from the first list, unless the second has it fuller.

    The lists are the stories that src0 to src9 and src5 to src19 tell; the fuller one has more articles there.
    """
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    part = lambda name, low, high: news.filter(number.between(low, high)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).select("cluster_id", F.lit(name).alias("from"), "n")
    both = part("a", 0, 9).unionByName(part("b", 5, 19))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "from"))
    return both.withColumn("place", place).filter("place = 1").drop("place")


def brief_picks(news: DataFrame, most: int = 8, cap: int = 2, candidates: int = 60) -> DataFrame:
    """Up to `most` stories for a brief: best first, `cap` a topic, none whose title nearly repeats a picked one.

    Greedy over the best `candidates` stories, a bounded list.
    """
    first = ranked_rows(news).filter("rank = 1").select("cluster_id", "topic", "title")
    best = story_scores(news).select("cluster_id", "synthesis").orderBy(F.desc("synthesis"), "cluster_id").limit(candidates).join(first, "cluster_id")

    def pick(frame):
        frame = frame.sort_values(["synthesis", "cluster_id"], ascending=[False, True])
        picked, topics, titles = [], {}, []
        for row in frame.itertuples():
            own = set((row.title or "").lower().split())
            near = any(own and t and len(own & t) / len(own | t) >= 0.72 for t in titles)
            if len(picked) < most and topics.get(row.topic, 0) < cap and not near:
                picked.append(row.cluster_id)
                titles.append(own)
                topics[row.topic] = topics.get(row.topic, 0) + 1
        out = frame[frame["cluster_id"].isin(picked)][["cluster_id", "topic"]]
        return out.assign(place=range(1, len(out) + 1))

    return best.withColumn("list", F.lit(1)).groupBy("list").applyInPandas(pick, "cluster_id string, topic string, place int")


def archive_totals(news: DataFrame) -> DataFrame:
    """Articles and distinct sources of the last 30 days, of the last day and hour, and the share not in English."""
    of = lambda hours: F.col("created_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    n = F.count_if(of(720))
    return news.agg(
        F.count(F.lit(1)).alias("total"), n.alias("month"), F.count_if(of(24)).alias("day"), F.count_if(of(1)).alias("hour"), F.count_distinct(F.when(of(720), F.col("source"))).alias("sources"),
        quantised(100.0 * F.count_if(of(720) & (F.col("category") != "en")) / F.greatest(n, F.lit(1)), 1).alias("international"),
    )


def title_classes(news: DataFrame) -> DataFrame:
    """(cluster_id, class, words) of stories whose title (the greatest of each) has long words; equal words, one class."""
    titles = news.groupBy("cluster_id").agg(F.max("title").alias("title")).filter("cluster_id is not null")
    words = titles.select("cluster_id", F.array_sort(long_words(F.col("title"))).alias("words")).filter(F.size("words") > 0)
    return words.select("cluster_id", F.sha2(F.array_join("words", " "), 256).alias("class"), "words")


def like_classes(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, like): classes (class, words) of different words that overlap by `least` or more, a before b.

    Only those that share one of the words that such an overlap forces are compared: of n words, in order of rarity, the
    first n - ceil(least * n) + 1. Where words meet, pairs go whose places and numbers of words leave too few words to
    share, and classes so small that one word more is too much. Nothing is lost by that.
    """
    enough = lambda shared, x, y: shared / (x + y - shared) >= least
    sized = classes.withColumn("n", F.size("words"))
    each = sized.select("class", "n", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("used"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("used", "word"))
    able = each.filter(enough(F.col("n"), F.col("n"), F.col("n") + 1)).join(often, "word").withColumn("place", place)
    rare = able.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("class", "word", "n", "place")
    left, right = rare.toDF("a", "word", "n", "i"), rare.toDF("b", "word", "m", "j")
    most = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    pairs = left.join(right, "word").filter((F.col("a") < F.col("b")) & enough(most, F.col("n"), F.col("m"))).select("a", "b").distinct()
    x, y = classes.select(F.col("class").alias("a"), F.col("words").alias("x")), classes.select(F.col("class").alias("b"), F.col("words").alias("y"))
    like = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", like.alias("like")).filter(F.col("like") >= least)


def title_pairs(news: DataFrame, least: float = 0.9, block: int = BLOCK_STORIES) -> DataFrame:
    """Stories to merge: titles (the greatest of each story) that overlap by `least` or more.

    Titles of equal words are one class, and only classes are compared. The stories of a class are dealt into blocks of
    about `block`; each two blocks of like classes meet in one row that gives their pairs one after another, in tasks of
    about TASK_PAIRS, so that no pair is shuffled, sorted or kept: pairs are quadratic, as stories of one title are.
    """
    with dropping(news.sparkSession):
        titles = written(title_classes(news), "titles")
        classes = written(titles.groupBy("class").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("stories")), "classes")
        parts = F.ceil(F.col("stories") / block).cast("int").alias("parts")
        dealt = titles.select("cluster_id", "class").join(classes.select("class", parts), "class")
        part = F.pmod(F.xxhash64("cluster_id"), F.col("parts")).cast("int").alias("part")
        blocks = written(dealt.select("class", part, "cluster_id").groupBy("class", "part").agg(F.collect_list("cluster_id").alias("ids")), "blocks")
        same = classes.filter("stories > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("like"))
        like = same.unionByName(like_classes(classes.select("class", "words"), least))
        for side in "ab":
            like = like.join(blocks.select(F.col("class").alias(side), F.col("part").alias(f"part_{side}"), F.col("ids").alias(f"ids_{side}")), side)
        met = kept(like.filter("a != b or part_a <= part_b"), "met")
        n = met.agg(F.sum(F.size("ids_a").cast("long") * F.size("ids_b"))).first()[0] or 0
    own = (F.col("a") == F.col("b")) & (F.col("part_a") == F.col("part_b"))
    spread = met.withColumn("own", own).repartition(max(LEAST_TASKS, -(-n // TASK_PAIRS)), "a", "b", "part_a", "part_b")
    pairs = spread.select("own", "like", "ids_b", F.explode("ids_a").alias("x")).select("own", "like", "x", F.explode("ids_b").alias("y")).filter("not own or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), quantised(F.col("like")).alias("overlap"))
