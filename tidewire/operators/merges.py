"""Merges of stories that are one: pairs by shared words, matches as in the repair of stories, stars of hubs (R9), and
the confidence that two stories are one (R10)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.adapters import news, table
from tidewire.functions import wording
from tidewire.operators.online import (
    ACCEPT, ANCHORED, GATE, INSTANT, SAME_TOPIC, SHARED, SHARED_MORE, article_keys, calibrated_similarity, headline, ratio_overlap, vector_of, word_links,
)
from tidewire.operators.ranking import hours_since
from tidewire.tables import dropping, kept, written

#: Hours from the clock in which stories are repaired, and hours between two stories' newest articles (fixed values).
REPAIR_HOURS, APART_HOURS = 48, 36
#: Topics without a subject of their own.
GENERAL = ("vesti", "news", "")


def story_heads(articles: DataFrame) -> DataFrame:
    """A row a story of articles (id, cluster_id, title, source, category, topic, created_at, e): its longest title (of
    equal ones that of the smallest id) as tokens and names with that article's category and topic, its up to three
    newest titles' tokens, articles, sources, mean vector, and hours and day of its newest article."""
    rows = articles.filter("cluster_id is not null and trim(title) <> ''").withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("created_at"), F.desc("id"))))
    head = F.max_by(F.struct("title", "category", "topic", "created_at"), F.struct(F.length("title"), -F.col("id"))).alias("head")
    titles = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "title")))).alias("titles")
    sums = rows.groupBy("cluster_id").agg(head, titles, F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.max("created_at").alias("newest"))
    parts = rows.filter("e is not null").select("cluster_id", F.posexplode("e").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("cluster_id", F.transform("c", lambda c: c["x"]).alias("e"))
    age, newest = -hours_since("head.created_at"), -hours_since("newest")
    return sums.join(means, "cluster_id", "left").select(
        F.col("cluster_id").alias("id"), wording.stems(F.col("head.title")).alias("tokens"), wording.title_entities(F.col("head.title")).alias("entities"), "head.category", "head.topic",
        F.transform("titles", lambda t: wording.stems(t["title"])).alias("titles"), "n", "n_sources", "e", age.alias("hours"), newest.alias("newest"), F.floor(newest / 24).alias("day"),
    )


def story_pairs(heads: DataFrame, gate: float | None = None, topical: bool = False) -> DataFrame:
    """Pairs (a, b) of stories within two days that share a word or name of their longest titles, each once; stories
    of one and the same title each with the first of its day and that with the first of the day before. With `gate` those
    whose vectors are farther apart are left out where the words meet, with `topical` those that confidence() calls unsafe.
    """
    keyed = heads.join(article_keys(heads.select("id", "day", "tokens", "entities")), "id", "left")
    safe = [F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("category", F.lit("")).alias("category"), "newest"] if topical else []
    each = keyed.select("id", "day", F.explode("keys").alias("key"), *safe, *(["e"] if gate is not None else []))
    twins = word_links(keyed.withColumn("keys", F.array().cast("array<string>"))).select(F.col("u").alias("a"), F.col("v").alias("b"))
    if gate is not None:
        pairs = _near_pairs(each, gate)
    else:
        day = F.explode(F.array("day", F.col("day") + 1)).alias("day")
        later = each.select(F.col("id").alias("b"), day, "key", *([F.col("topic"), F.col("category").alias("other"), F.col("newest").alias("then")] if topical else []))
        pairs = each.withColumnRenamed("id", "a").join(later, ["day", "key", *(["topic"] if topical else [])])
        if topical:
            pairs = pairs.filter(((F.col("category") == F.col("other")) | F.col("category").isin("") | F.col("other").isin("")) & (F.abs(F.col("newest") - F.col("then")) <= APART_HOURS))
    both = pairs.select("a", "b").unionByName(twins).filter("a != b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near_pairs(each: DataFrame, gate: float) -> DataFrame:
    """Pairs (a, b) of (id, day, key, e) that share a key within two days and are `gate` near or cannot be compared.
    Vectors go once a key and day, not once a pair."""

    def groups(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = [vector_of(x) for x in table["e"].to_pylist()]
        size = np.array([0 if x is None else len(x) for x in found])
        unit = np.zeros((len(found), size.max(initial=1)))
        for i, x in enumerate(found):
            if x is not None:
                unit[i, : len(x)] = x / np.sqrt(x @ x)
        own, ids, place = table["own"].to_numpy(), table["id"].to_numpy(), table["group"].to_numpy()
        for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(place)) + 1):
            lefts = at[own[at]]
            for left in np.split(lefts, range(512, len(lefts), 512)):
                comparable = (size[left][:, None] == size[at]) & (size[at] > 0)
                i, j = np.nonzero((ids[left][:, None] != ids[at]) & (~comparable | (calibrated_similarity(unit[left] @ unit[at].T) >= gate - 1e-9)))
                yield ids[left[i]], ids[at[j]]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            days, keys = table["d"].to_numpy(), table["key"].to_numpy()
            place = np.concatenate([[0], np.cumsum((days[1:] != days[:-1]) | (keys[1:] != keys[:-1]))])
            last = int(np.searchsorted(place, place[-1]))
            held = table.slice(last)
            yield from _batches(groups(table.append_column("group", pa.array(place)).slice(0, last)))
        if held is not None:
            yield from _batches(groups(held.append_column("group", pa.array(np.zeros(len(held), int)))))

    def _batches(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        pairs = list(found)
        if pairs:
            yield pa.record_batch([pa.array(np.concatenate(x), pa.string()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    rows = each.select("id", "key", "e", "day", F.explode(F.array("day", F.col("day") + 1)).alias("d")).withColumn("own", F.col("d") == F.col("day"))
    return rows.drop("day").repartition("d", "key").sortWithinPartitions("d", "key").mapInArrow(paired, "a string, b string")


#: What the rules read of a story: matching_overlap() and confidence().
_MATCHED = ("tokens", "entities", "category", "topic", "e")
_TRUSTED = ("entities", "category", "topic", "titles", "e", "newest")


def _with_sides(pairs: DataFrame, heads: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    side = lambda k: heads.select(F.col("id").alias(k), F.struct(*columns).alias(f"{k}_"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def nearness(a: dict, b: dict) -> float | None:
    """Calibrated similarity of two stories' mean vectors; None where one has none or they differ in length."""
    x, y = vector_of(a["e"]), vector_of(b["e"])
    if x is None or y is None or len(x) != len(y):
        return None
    return float(calibrated_similarity(float(x @ y) / float(np.sqrt((x @ x) * (y @ y)))))


def matching_overlap(a: dict, b: dict) -> float | None:
    """The overlap of two stories' titles if they are one story (R9), else None: near vectors where both have them, then
    nearly equal titles, or a shared name with overlap, or two names; another category asks for two names or .40."""
    near = nearness(a, b)
    if near is not None and near < GATE:
        return None
    shared = len({x for x in set(a["entities"]) & set(b["entities"]) if not x.isdigit()})
    overlap = ratio_overlap(a["tokens"], b["tokens"], {0: INSTANT, 1: ANCHORED}.get(shared, 0.0))
    if overlap >= INSTANT:
        return overlap
    if not shared or (shared < 2 and overlap < ANCHORED):
        return None
    if a["category"] and b["category"] and a["category"] != b["category"] and shared < 2 and overlap < 0.40:
        return None
    score = overlap + SHARED + SHARED_MORE * (shared > 1) + SAME_TOPIC * bool(a["topic"] and a["topic"] == b["topic"])
    return overlap if score >= ACCEPT else None


def confidence(a: dict, b: dict) -> float:
    """The confidence that two stories are one (R10), 0 if that is unsafe: equal topics, categories that do not differ,
    newest articles within APART_HOURS; words by the cosine of the counts of three titles each, phrases by the best
    overlap, tags (names of the titles) and vectors add to it; general topics ask for tags."""
    if (a["category"] and b["category"] and a["category"] != b["category"]) or (a["topic"] or "") != (b["topic"] or "") or abs(a["newest"] - b["newest"]) > APART_HOURS:
        return 0.0
    left, right = (Counter(w for t in s["titles"] for w in t) for s in (a, b))
    norm = np.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
    lexical = sum(left[w] * right[w] for w in left.keys() & right.keys()) / norm if norm else 0.0
    tags = len(set(a["entities"]) & set(b["entities"]) - set(GENERAL))
    if lexical < (0.24 if tags else 0.36) and (not tags or (a["topic"] or "").strip().lower() in GENERAL):
        return 0.0
    phrase = 0.0
    for x in a["titles"]:
        for y in b["titles"]:
            phrase = max(phrase, ratio_overlap(x, y, phrase))
    near = nearness(a, b) or 0.0
    if (a["topic"] or "").strip().lower() in GENERAL:
        if tags >= 2 and lexical >= 0.30:
            return round(lexical + phrase + 0.08 * tags + 0.2 * near, 4)
        return round(lexical + phrase + 0.35 * near, 4) if tags and lexical >= 0.24 and near >= 0.78 else 0.0
    if lexical >= 0.36 or (phrase >= 0.22 and tags):
        return round(lexical + phrase + 0.06 * tags + 0.15 * near, 4)
    return 0.0


def _judged(pairs: DataFrame, rule) -> DataFrame:
    """(a, b, score) of pairs with sides for which `rule` gives a score."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [rule(x, y) for x, y in zip(batch.column("a_").to_pylist(), batch.column("b_").to_pylist(), strict=True)]
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())], names=["a", "b", "score"])
            yield out.filter(pa.array([bool(s) for s in scores], pa.bool_()))

    # by a hash of both, as pairs already dealt by a and b would stay in the few tasks that their bytes ask for
    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("a", "b"))
    return dealt.mapInArrow(judge, "a string, b string, score double")


def repair_pairs(heads: DataFrame, hours: float = REPAIR_HOURS) -> DataFrame:
    """Pairs of stories of the last `hours` that are one story (R9), with their overlap."""
    fresh = heads.filter(F.col("hours") >= -hours)
    return _judged(_with_sides(story_pairs(fresh, gate=GATE), fresh, _MATCHED), matching_overlap)


def merge_confidence(heads: DataFrame) -> DataFrame:
    """Pairs of stories that may be one, with the confidence."""
    return _judged(_with_sides(story_pairs(heads, topical=True), heads, _TRUSTED), confidence).withColumnRenamed("score", "confidence")


def star_merges(pairs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(story, into): which story goes into which, from pairs (a, b) and, of each story, (id, n, n_sources).

    Hubs come by number of pairs, articles, sources (most first) and id; each takes its neighbours that no earlier hub
    has, and no chain is followed. Within a star the story of most articles, sources, smallest id stays. Decided in
    rounds until no pair of free stories is left: a hub is a story that no free one within two steps comes before, which
    is the order's own choice, so the result is that of the one-by-one walk. Each round is a written table.
    """
    spark = pairs.sparkSession
    with dropping(spark):
        pairs = written(pairs.select("a", "b"), "judged")  # read four times below
        both = pairs.filter("a != b").select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
        degree = both.groupBy("a").agg(F.count("*").alias("d"))
        if sizes is not None:
            degree = degree.join(sizes.select(F.col("id").alias("a"), "n", "n_sources"), "a", "left")
        else:
            degree = degree.withColumns({"n": F.lit(1).cast("long"), "n_sources": F.lit(1).cast("long")})
        own = F.struct((-F.coalesce("n", F.lit(0))).alias("n"), (-F.coalesce("n_sources", F.lit(0))).alias("s"), F.col("a").alias("id"))
        ranks = degree.select("a", F.struct((-F.col("d")).alias("d"), own.alias("own")).alias("r"))
        ranks_b = ranks.select(F.col("a").alias("b"), F.col("r").alias("q"))
        now = written(both.join(ranks, "a").join(ranks_b, "b").select("a", "b", "r", "q"), "pairs")
        stars = []
        while not now.isEmpty():
            first = now.groupBy("a", "r").agg(F.min("q").alias("m")).select("a", "r", F.least("m", "r").alias("m"))
            first = written(first, "first")
            far = now.join(first.select(F.col("a").alias("b"), "m"), "b").groupBy("a", "r").agg(F.min("m").alias("m"))
            hubs = far.filter("m >= r").select(F.col("a").alias("hub"))
            taken = written(now.join(hubs, now["b"] == hubs["hub"], "left_semi").select(F.col("a").alias("story"), F.col("r.own").alias("own"), F.col("b").alias("hub"), F.col("q.own").alias("hub_own")), "taken")
            stars.append(taken)
            gone = taken.select(F.col("story").alias("g")).unionByName(taken.select(F.col("hub").alias("g"))).distinct()
            now = written(now.join(gone, now["a"] == gone["g"], "left_anti").join(gone, now["b"] == gone["g"], "left_anti"), "pairs")
        if not stars:
            return spark.createDataFrame([], "story string, into string")
        every = stars[0]
        for part in stars[1:]:
            every = every.unionByName(part)
        every = every.select("hub", "story", "own").unionByName(every.select("hub", F.col("hub").alias("story"), F.col("hub_own").alias("own")).distinct())
        chosen = every.groupBy("hub").agg(F.min("own").alias("best")).select("hub", F.col("best.id").alias("into"))
        return kept(every.join(chosen, "hub").filter("story != into").select("story", "into"), "merges")


def news_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    return story_heads(news(spark, sf_dir).withColumn("title", headline(F.col("title"))).join(vectors, "id", "left"))


def merge_plan(spark: SparkSession, sf_dir: str, hours: float = 31 * 24) -> DataFrame:
    """Stories to merge and the one they go into (R9). The test tables spread stories over a month, so `hours` is one."""
    with dropping(spark):
        heads = written(news_heads(spark, sf_dir), "heads")
        return kept(star_merges(repair_pairs(heads, hours), heads), "plan")


def story_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stories with the confidence that they are one."""
    with dropping(spark):
        heads = written(news_heads(spark, sf_dir), "heads")
        return kept(merge_confidence(heads), "confidence")
