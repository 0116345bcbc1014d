"""Connected components of an edge table by contraction.

Each round points every node at the smallest node of its neighbourhood, jumps once along the pointers, and replaces
the edges' ends by what they point at: components shrink by a constant factor a round, in expectation over ids that
are in no order along the edges (fingerprints, hashes). Rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._store import Table, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is one node of its component, the same for all of it.

    Self-loops, repeated edges and edges with a null end change nothing; nodes of such edges alone do not appear.
    """
    spark = edges.sparkSession
    pairs = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    now = Table(spark, edges.filter("u != v").select(pairs.alias("e")).select("e.u", "e.v").distinct(), "edges")
    found = None
    while not now.df.isEmpty():
        nearest = Table(spark, now.df.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), "nearest")
        next_of = nearest.df.select(F.col("u").alias("to"), F.col("to").alias("far"))
        jumped = Table(spark, nearest.df.join(next_of, "to").select("u", F.col("far").alias("to")), "jumped")
        left = jumped.df.select("u", F.col("to").alias("nu"))
        right = jumped.df.select(F.col("u").alias("v"), F.col("to").alias("nv"))
        kept = now.df.join(left, "u").join(right, "v").filter("nu != nv").select(F.col("nu").alias("u"), F.col("nv").alias("v")).distinct()
        after = Table(spark, kept, "edges")
        if found is None:
            found = jumped.df.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            step = jumped.df.select(F.col("u").alias("root"), "to")
            found = written(found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        now.drop()
        nearest.drop()
        now = after
    return found if found is not None else now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
