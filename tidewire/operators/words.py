"""Wording functions applied to whole tables, bag-of-words cosine, centred vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wording
from tidewire.operators.stories import quantised


def title_keys(docs: DataFrame) -> DataFrame:
    """Keys of the first lines."""
    return docs.select("doc_id", wording.title_key(F.substring_index("text", "\n", 1)).alias("key"))


def folded_titles(docs: DataFrame) -> DataFrame:
    """First lines without diacritics."""
    return docs.select("doc_id", wording.folded(F.substring_index("text", "\n", 1)).alias("title"))


def cyrillic_titles(docs: DataFrame) -> DataFrame:
    """First lines in Cyrillic script."""
    return docs.select("doc_id", wording.to_cyrillic(F.substring_index("text", "\n", 1)).alias("title"))


def embedding_texts(docs: DataFrame) -> DataFrame:
    """What a text's embedding is made of: the first line and 300 characters (F24), which is its feature."""
    return docs.select("doc_id", wording.embedding_text(F.col("text")).alias("input"))


def stem_counts(docs: DataFrame) -> DataFrame:
    """Stems of all texts and how often each stands there."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(wording.TOKEN), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.explode(wording.stems(F.col("word"))).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))  # each word is stemmed once


def entity_counts(docs: DataFrame) -> DataFrame:
    """Entities of all first lines and the documents and sources of each."""
    found = docs.select("source", F.explode(wording.title_entities(F.substring_index("text", "\n", 1))).alias("entity"))
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))


def turn_cosine(conversations: DataFrame) -> DataFrame:
    """Cosine of the stem counts of each turn and the turn before it, joined on stems (F20); 0 where none is shared."""
    words = conversations.select("conv_id", "turn", F.explode(wording.stems(F.col("text"))).alias("stem")).groupBy("conv_id", "turn", "stem").agg(F.count(F.lit(1)).alias("n"))
    norms = words.groupBy("conv_id", "turn").agg(F.sum(F.col("n") * F.col("n")).alias("norm"))
    before = words.select("conv_id", (F.col("turn") + 1).alias("turn"), "stem", F.col("n").alias("m"))
    shared = words.join(before, ["conv_id", "turn", "stem"]).groupBy("conv_id", "turn").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    earlier = norms.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("norm").alias("norm_before"))
    rows = norms.join(earlier, ["conv_id", "turn"]).join(shared, ["conv_id", "turn"], "left")
    cosine = F.coalesce("dot", F.lit(0)) / F.sqrt(F.col("norm") * F.col("norm_before"))
    return rows.select("conv_id", "turn", quantised(cosine, 4).alias("cosine"))


def calibrated_distances(events: DataFrame) -> DataFrame:
    """Distances of 0 to 2.099 (the event's number modulo 2100, in thousandths) on the other scale, both ways."""
    x = F.pmod("event_id", F.lit(2100)) / 1000.0
    return events.select("event_id", quantised(wording.calibrated(x)).alias("there"), quantised(wording.calibrated(x, back=True)).alias("back"))


def centred_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors less the mean of all, of length 1, a row a component (F23). The mean is one row, broadcast."""
    mean = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))
    apart = vectors.join(F.broadcast(whole)).select("vec_id", F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda t, x: t + x * x))
    rows = apart.select("vec_id", norm.alias("norm"), F.posexplode("c").alias("i", "x"))
    return rows.select("vec_id", "i", quantised(F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")), 4).alias("x"))
