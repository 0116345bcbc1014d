"""Sharding along a Hilbert curve over several metadata dimensions.

Source, language and size are quantised, the rows are sorted by their place on the curve, and the order is cut into
runs of near-equal bytes: readers that filter on any of the dimensions skip most files by their minima and maxima.
Equal texts take the metadata of their first row, so that copies stand side by side; a group that is small against
a shard is never cut, a larger one may be. Ranks and running bytes come from sampled ranges and bucket totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewire.llm._ranges import bucket_prefix, default_ranges, range_bucket, sortable, split_points
from tidewire.llm._store import kept, scratch, written

SHARDS, BITS, DIMENSIONS = 16, 8, 3
#: A group of equal texts with less than this share of a shard's bytes stays in one shard.
WHOLE_GROUP = 0.02


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with `bits` bits a dimension, by Skilling's transposition."""
    x = [a.astype(np.int64).copy() for a in axes]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], BITS))


def _levels(rows: DataFrame, name: str) -> DataFrame:
    """Each value of a text column, with the middle of its share of rows in order of value, in BITS bits; null last."""
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col(name).asc_nulls_last())
    middle = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    share = middle / F.sum("n").over(Window.partitionBy(F.lit(1)))
    level = F.least(F.lit((1 << BITS) - 1), F.floor(share * (1 << BITS))).cast("int")
    return counts.select(F.col(name).alias(f"{name}_value"), level.alias(f"{name}_level"))


def curve_shards(docs: DataFrame, shards: int = SHARDS, n_ranges: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    law is `bytes`: shards hold near-equal sums of sizes (UTF-8 bytes of the text plus 1; null has no bytes).
    Null source, language and n_chars are values of their own (last, last, 0). Ties on the curve go by the text's
    MD5, then doc_id, null last. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with scratch() as made:
        data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
        rows = written(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("n_chars"), (F.octet_length(data) + 1).cast("long").alias("size"),
                F.crc32(data).alias("text_crc32"), F.concat(F.md5(data), F.when(F.col("text").isNull(), "n").otherwise("t")).alias("h"),
            ),
            "shard-rows",
        )
        first = F.min(F.struct("doc_id", "source", "lang", "n_chars")).alias("r")
        copies = written(
            rows.groupBy("h").agg(first, F.count(F.lit(1)).alias("n"), F.sum("size").alias("group_bytes")).filter("n > 1")
            .select("h", F.col("r.source").alias("r_source"), F.col("r.lang").alias("r_lang"), F.col("r.n_chars").alias("r_chars"), "group_bytes"),
            "copies",
        )
        grouped = rows.join(copies, "h", "left")
        of_group = lambda own, rep: F.when(F.col("group_bytes").isNull(), F.col(own)).otherwise(F.col(rep)).alias(own)
        grouped = grouped.select("doc_id", "size", "text_crc32", "h", "group_bytes", of_group("source", "r_source"), of_group("lang", "r_lang"), of_group("n_chars", "r_chars"))
        for name in ("source", "lang"):
            levels = written(_levels(rows, name), f"{name}-levels")
            grouped = grouped.join(levels, F.col(name).eqNullSafe(F.col(f"{name}_value")), "left")
        chars = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1) * 12)).cast("int")
        level = lambda name: F.coalesce(F.col(name), F.lit((1 << BITS) - 1))
        placed = grouped.withColumn("curve", _curve(level("source_level"), level("lang_level"), chars))
        placed = written(placed.select("doc_id", "size", "text_crc32", "h", "group_bytes", "curve"), "on-curve")
        key = F.concat(F.lpad(F.hex("curve"), 6, "0"), "h", sortable(F.col("doc_id")))
        ranged = placed.withColumn("p", range_bucket(key, split_points(placed, key, n_ranges or default_ranges(spark))))
        order = Window.partitionBy("p").orderBy("curve", "h", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        inner = ranged.withColumn("end_in", F.sum("size").over(order)).withColumn("rank_in", F.count(F.lit(1)).over(order))
        below = written(bucket_prefix(ranged, "p", bytes_below=F.sum("size"), rows_below=F.count(F.lit(1))), "range-prefix")
        total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
        at = kept(
            inner.join(below, "p").select(
                "doc_id", "size", "text_crc32", "h", "group_bytes", "curve",
                (F.col("bytes_below") + F.col("end_in")).alias("end"), (F.col("rows_below") + F.col("rank_in")).alias("rank"),
            ),
            "in-order", made,
        )
        small = F.col("group_bytes") <= WHOLE_GROUP * total / shards
        starts = kept(at.filter(small).groupBy("h").agg(F.min(F.col("end") - F.col("size")).alias("group_start")), "group-starts", made)
    middle = F.coalesce(F.col("group_start") + F.col("group_bytes") / 2, F.col("end") - F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1))))).cast("int")
    cut = at.join(starts, "h", "left").withColumn("shard", shard)
    firsts = cut.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # one row a shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes `docs` under `path`, a folder a shard (`shard=N`), each sorted along the curve.

    Rows are told by doc_id and CRC of the text; repeated ones stand together. Columns keep their names: they are
    written in one column `row` where one of them is named `shard`, as the folders take that name. An empty table
    writes no shard.
    """
    plan = curve_shards(docs, shards).groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("at"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    crc = F.crc32(F.encode(F.coalesce(F.col("row.text"), F.lit("")), "UTF-8"))
    joined = whole.join(plan, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (crc == F.col("text_crc32")))
    placed = joined.select("row", F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"))
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    clash = any(c.lower() == "shard" for c in docs.columns)
    ordered.select("shard", "row" if clash else "row.*").write.partitionBy("shard").parquet(path)
