"""Range partitioning by sampled splitters, as a bucket column, and running sums over a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: At most so many ranges; the sampled keys that reach the driver are 16 a range at most, of fixed width.
MAX_RANGES, SAMPLES_PER_RANGE = 32_768, 16


def default_ranges(spark: SparkSession) -> int:
    """Some ranges per shuffle partition, so that hashing ranges to partitions stays even."""
    return max(8, min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def split_points(df: DataFrame, key: Column, n_ranges: int, n_rows: int | None = None, seed: int = 7) -> list:
    """At most n_ranges - 1 splitters of a key, from a sample whose size n_ranges bounds.

    The key is a double, or a string of bounded length without 0x01.
    """
    n_rows = df.count() if n_rows is None else n_rows
    want = n_ranges * SAMPLES_PER_RANGE
    sample = df.sample(False, want / n_rows, seed) if n_rows > want else df
    keys = sorted(r[0] for r in sample.select(key.alias("k")).collect())
    if len(keys) < 2:
        return []
    return sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)})


def range_bucket(key: Column, splitters: list) -> Column:
    """Number of splitters at or below `key`: a binary search inside the expression."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    held = F.split(F.lit("\x01".join(map(str, splitters))), "\x01")
    if not isinstance(splitters[0], str):
        held = held.cast("array<double>")  # repr() of a double reads back as it was
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.try_element_at(held, low + step) <= key), low + step).otherwise(low),
    )


def sortable(number: Column) -> Column:
    """A long as 16 hex digits in its order; null comes last."""
    return F.coalesce(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("G"))


def bucket_prefix(df: DataFrame, bucket: str, **sums: Column) -> DataFrame:
    """Per bucket, for each named sum, the total over all lower buckets. One row a bucket: small by construction."""
    totals = df.groupBy(bucket).agg(*[c.alias(k) for k, c in sums.items()])
    below = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(bucket, *[F.coalesce(F.sum(k).over(below), F.lit(0)).alias(k) for k in sums])
