"""Rows to write: inserts that skip known keys, and upserts, as plans over whole tables (Parquet has no MERGE)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_new(known: DataFrame, rows: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    """Rows whose key is not known yet, of each key the first by `first` (S8). A null key part is a value like others."""
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*first)).alias("r")).select("r.*")
    old = known.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return kept.join(old, same, "left_anti")


def upserted(known: DataFrame, rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The table after an upsert: of each key the new row, else the old one, the latest by `version`.

    An aggregate with partial maxima: no sort, and a crowded key is reduced before the shuffle.
    """
    both = known.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    latest = F.max_by(F.struct(*known.columns), F.struct("_new", *version)).alias("r")
    return both.groupBy(*keys).agg(latest).select("r.*")


def added(known: DataFrame, rows: DataFrame, keys: list[str], sums: list[str], latest: list[str]) -> DataFrame:
    """The table after `rows` are added: `sums` add up, `latest` take the greater, by key; a null key is a key."""
    both = known.unionByName(rows)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


def archived(known: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `known` that an upsert of `rows` overwrites: what goes to the history first (S11). A null key is a key."""
    new = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return known.join(new, same, "left_semi")
