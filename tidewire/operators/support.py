"""Claims of a text held against its sources: the share that a stretch of a source supports."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.ranking import ranked_rows

#: Nearness from which a claim is supported, stretches that a story must have, sentences of a stretch, claims of
#: a text, and letters of a claim, of a sentence and of a stretch that count.
SUPPORT, LEAST_STRETCHES, SENTENCES, CLAIMS = 0.33, 2, 3, 12
CLAIM_LETTERS, SENTENCE_LETTERS, STRETCH_LETTERS = 20, 20, 40
_END = "\ue000"


def sentences(text: Column) -> Column:
    """Sentences of a text without tags, with single spaces."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"\s+", " "))
    return F.split(F.regexp_replace(bare, r"([.!?…]) ", f"$1{_END}"), _END)


def claims_of(texts: DataFrame, most: int = CLAIMS) -> DataFrame:
    """(story, claim, text): the first `most` sentences of CLAIM_LETTERS or more of each (story, text)."""
    rows = texts.select("story", F.posexplode(sentences(F.col("text"))).alias("i", "text")).filter(F.length("text") >= CLAIM_LETTERS)
    place = F.row_number().over(Window.partitionBy("story").orderBy("i"))
    return rows.select("story", place.alias("claim"), "text").filter(F.col("claim") <= most)


def stretches_of(sources: DataFrame) -> DataFrame:
    """(story, stretch, text): titles, and stretches of three sentences, of (story, id, title, body); equal ones once."""
    long = F.filter(sentences(F.col("body")), lambda s: F.length(s) > SENTENCE_LETTERS)
    starts = F.when(F.size("l") > 0, F.sequence(F.lit(1), F.size("l"), F.lit(SENTENCES)))
    bodies = sources.select("story", long.alias("l")).select("story", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("l", k, SENTENCES), " "))).alias("text"))
    titles = sources.select("story", F.trim(F.regexp_replace(F.regexp_replace("title", "<[^>]+>", " "), r"\s+", " ")).alias("text")).filter("text <> ''")
    rows = titles.unionByName(bodies.filter(F.length("text") > STRETCH_LETTERS)).distinct()
    return rows.select("story", F.md5("text").alias("stretch"), "text")


def words_of(text: Column) -> Column:
    """A text's words in lower case, a space between them: one string goes to Python faster than an array."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def best_support(claims: DataFrame, stretches: DataFrame) -> DataFrame:
    """(story, claim, support): the greatest cosine of a claim's word counts with a stretch of its story.

    A story has at most CLAIMS claims, so they go with each of its stretches, which are compared where they lie: a stretch
    is a row with its story's claims, and only the greatest cosine of a batch is left of it. No word is shuffled.
    """
    kinds = {name: claims.schema[name].dataType.simpleString() for name in ("story", "claim")}
    own = claims.groupBy("story").agg(F.collect_list(F.struct("claim", words_of(F.col("text")).alias("words"))).alias("claims"))
    met = stretches.select("story", words_of(F.col("text")).alias("words")).join(own, "story").select("story", "words", F.col("claims.claim").alias("claim"), F.array_join("claims.words", "\n").alias("claimed"))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stories, best, counted = batch.column("story").to_pylist(), {}, {}
            for at, (story, words) in enumerate(zip(stories, batch.column("words").to_pylist(), strict=True)):
                if story not in counted:
                    counted[story] = [(c, Counter(w.split())) for c, w in zip(batch.column("claim")[at].as_py(), batch.column("claimed")[at].as_py().split("\n"), strict=True)]
                    counted[story] = [(c, n, sum(x * x for x in n.values())) for c, n in counted[story]]
                stretch = Counter(words.split())
                size = sum(x * x for x in stretch.values())
                for claim, n, square in counted[story]:
                    dot = sum(n[w] * stretch[w] for w in n.keys() & stretch.keys())
                    if dot and (support := dot / sqrt(square * size)) > best.get((story, claim), 0.0):
                        best[story, claim] = support
            columns = [[s for s, _ in best], [c for _, c in best]]
            arrays = [pa.array(columns[0], batch.schema.field("story").type), pa.array(columns[1], batch.schema.field("claim").type.value_type), pa.array(best.values(), pa.float64())]
            yield pa.record_batch(arrays, names=["story", "claim", "support"])

    best = met.mapInArrow(cosines, f"story {kinds['story']}, claim {kinds['claim']}, support double").groupBy("story", "claim").agg(F.max("support").alias("support"))
    return claims.select("story", "claim").join(best, ["story", "claim"], "left").select("story", "claim", F.coalesce("support", F.lit(0.0)).alias("support"))


def supported(claims: DataFrame, stretches: DataFrame, least: float = SUPPORT) -> DataFrame:
    """(story, claims, supported, share to three digits) of stories with claims and LEAST_STRETCHES stretches."""
    enough = stretches.groupBy("story").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_STRETCHES).select("story")
    rows = best_support(claims, stretches).join(enough, "story", "left_semi")
    sums = rows.groupBy("story").agg(F.count("*").alias("claims"), F.count_if(F.col("support") >= least).alias("supported"))
    return sums.withColumn("share", F.floor(F.col("supported") / F.col("claims") * 1000 + 0.5) / 1000)


def faithfulness(news: DataFrame) -> DataFrame:
    """How far the other articles of a story support its best-ranked one, which stands for a summary."""
    rows = ranked_rows(news).select(F.col("cluster_id").alias("story"), "id", "title", F.col("description").alias("body"), "rank")
    claims = claims_of(rows.filter("rank = 1").select("story", F.col("body").alias("text")))
    return supported(claims, stretches_of(rows.filter("rank > 1")))
