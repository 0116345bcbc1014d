"""An inverted index of the news, with positions: built once a session and directory, read by the searches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.adapters import news
from tidewire.operators.stories import quantised
from tidewire.tables import written

TOKEN = r"[\p{L}\p{N}]+"
#: Weights of a hit in the title and in the description (fixed values).
IN_TITLE, IN_TEXT = 1.0, 0.4

_BUILT: dict[tuple[str, str], DataFrame] = {}


#: Articles whose words are grouped at once.
AT_ONCE = 500


def postings(articles: DataFrame) -> DataFrame:
    """(term, id, n_title, positions) of articles (id, title, description), ids unique: where each word stands, from 0, the
    description's words after the n_title of the title. An article without words has no row; null is empty. The words
    of an article are grouped where it is read, so none is shuffled."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))
    rows = articles.select("id", words("title").alias("t"), words("description").alias("d"))
    rows = rows.select("id", F.size("t").alias("n_title"), F.concat("t", "d").alias("words"))
    at_once = AT_ONCE

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                lists = batch.column("words")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                if not len(coded):
                    continue
                own = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = own * len(coded.dictionary) + coded.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                heads = pa.array(order[first])
                owners = pa.array(own[order[first]])
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
                yield pa.record_batch(
                    [coded.dictionary.take(coded.indices.take(heads)), batch.column("id").take(owners), batch.column("n_title").take(owners), positions], names=["term", "id", "n_title", "positions"]
                )

    return rows.mapInArrow(grouped, f"term string, id {articles.schema['id'].dataType.simpleString()}, n_title int, positions array<int>")


def news_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written postings of the news under `sf_dir`, in order of term, so that a search reads the row groups of its
    words only. It is built at the first use in a session; forget() has it built anew."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        rows = postings(news(spark, sf_dir))
        _BUILT[key] = written(rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "postings")
    return _BUILT[key]


def forget(sf_dir: str) -> None:
    """The next search builds the index of `sf_dir` anew, as after a change of its tables."""
    for key in [k for k in _BUILT if k[1] == sf_dir]:
        del _BUILT[key]


def ranks(index: DataFrame, query: str) -> DataFrame:
    """(id, rank) of articles that hold all words of the query, by the density of their covers.

    A cover is a stretch from one hit to another that holds all words and none of whose parts does. It counts the mean
    weight of its hits (harmonic) over one plus the words in it that are no hits; a rank is the sum over covers, which
    is the store's own, to 6 digits. Hits of an article are numbered in windows, so no list of them is built.
    """
    terms = sorted(set(query.lower().split()))
    rows = index.filter(F.col("term").isin(terms)).select("id", "term", "n_title", F.explode("positions").alias("position"))
    weight = F.when(F.col("position") < F.col("n_title"), IN_TITLE).otherwise(IN_TEXT)
    order = Window.partitionBy("id").orderBy("position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hits = rows.select("id", "term", "position", F.row_number().over(order).alias("i"), F.sum(1 / weight).over(upto).alias("s"), (1 / weight).alias("own"))
    start = F.struct("i", "position", (F.col("s") - F.col("own")).alias("before"))
    last = [F.last(F.when(F.col("term") == t, start), ignorenulls=True).over(upto).alias(f"t{k}") for k, t in enumerate(terms)]
    seen = hits.select("id", "i", "position", "s", *last)
    every = reduce(lambda a, b: a & b, [F.col(f"t{k}").isNotNull() for k in range(len(terms))])
    first = F.least(*[F.col(f"t{k}") for k in range(len(terms))]) if len(terms) > 1 else F.col("t0")
    covers = seen.filter(every).withColumn("p", first).groupBy("id", "p").agg(F.min(F.struct("i", "position", "s")).alias("q"))
    n = F.col("q.i") - F.col("p.i") + 1
    noise = F.col("q.position") - F.col("p.position") - n + 1
    density = n / (F.col("q.s") - F.col("p.before")) / (1 + noise)
    return covers.groupBy("id").agg(quantised(F.sum(density)).alias("rank"))
