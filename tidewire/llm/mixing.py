"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in a shuffled order (MD5 of the doc_id), read twice at most. A document's
virtual finish time is its source's running word count divided by the source's target; all documents are range-sorted
by finish time, and the mix is the prefix that fits the total budget. Running counts come in two levels: sampled
splitters cut an order into ranges, each range sums inside itself, and the ranges' totals are summed before it. Rows
are numbered as they are first written, so that equal ones, however many, spread over ranges like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._ranges import bucket_prefix, default_ranges, range_bucket, split_points
from tidewire.llm._store import Table, kept, scratch, written

WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes; times that a source, and a document, may be read.
BUDGET, REPEATS = 1.5, 2


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, repeats=REPEATS) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources by code point, null last.

    A target is the weight times one common level, at most `repeats` times the source's size; what that cuts off
    goes to the others by weight. The level comes from one pass over the sources in order of size over weight.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1)
    rows = sums.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(repeats))).alias("cap"), F.lit(1).alias("one"))
    everything = Window.partitionBy("one")
    by_ratio = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    held = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    rows = rows.withColumn("common", F.max(held).over(everything))
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("common") * F.col("w")), F.col("cap")).alias("target"))


def fair_mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, repeats=REPEATS, n_ranges: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null text has size 0 and takes 0; a null source is a source of its own, after all others; ties of the shuffled
    order go by doc_id (null first), then size. Equal rows share what they take in any order. An empty table gives
    an empty result; if all sizes are 0, so are all targets. Other columns are ignored.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or default_ranges(spark)
    with scratch() as made:
        skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
        sizes = Table(
            spark,
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), skey.alias("skey"), size_of(F.col("text")).alias("size"),
                F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("row"),
            ),
            "sizes",
        )
        targets = written(source_targets(sizes.df, weights, budget, repeats).withColumn("skey", _skey()), "targets")
        # The queues: one order over (source, MD5, size, row), so a source's rows lie side by side in few ranges or many.
        order_key = F.concat(F.md5("skey"), "h", F.lpad(F.hex("size"), 16, "0"), F.lpad(F.hex("row"), 16, "0"))
        rows = sizes.df.withColumn("p", range_bucket(order_key, split_points(sizes.df, order_key, n_ranges)))
        inside = Window.partitionBy("p", "skey").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
        totals = rows.groupBy("skey", "p").agg(F.sum("size").alias("in_range"))
        below = Window.partitionBy("skey").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and source
        before = written(totals.select("skey", "p", F.coalesce(F.sum("in_range").over(below), F.lit(0)).alias("before")), "queue-prefix")
        running = rows.withColumn("inside", F.sum("size").over(inside)).join(before, ["skey", "p"])
        known = targets.select("skey", "source_size", "target")
        queue = kept(
            running.withColumn("cum", F.col("before") + F.col("inside")).select("doc_id", "source", "skey", "size", "row", "cum").join(known, "skey"), "queues", made
        )
        # The global order by finish time; within a source no two rows of a reading finish together.
        finish = (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target")
        waiting = queue.filter("target > 0 and size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(repeats)]))).withColumn("finish", finish)
        events = waiting.withColumn("p", range_bucket(F.col("finish"), split_points(waiting, F.col("finish"), n_ranges)))
        by_finish = Window.partitionBy("p").orderBy("finish", "skey", "epoch", F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, 0)
        lower = written(bucket_prefix(events, "p", lower=F.sum("size")), "finish-prefix")
        total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).collect()[0][0]
        limit = F.lit(float(total) * min(budget, repeats))
        taken = events.withColumn("inside", F.sum("size").over(by_finish)).join(lower, "p").filter(F.col("lower") + F.col("inside") <= limit)
        reached = kept(taken.groupBy("skey").agg(F.max(F.col("cum") + F.col("epoch") * F.col("source_size")).alias("reached")), "reached", made)
    times = [F.when(F.col("cum") + i * F.col("source_size") <= F.col("reached"), F.col("size")).otherwise(0) for i in range(repeats)]
    return queue.join(reached, "skey", "left").select(
        "doc_id", "source", "size", "source_size", "target", sum(times[1:], times[0]).cast("long").alias("taken")
    )


def _skey() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """`docs` as the mix takes them: rows that it takes twice come twice, the others once or not at all.

    Documents without words take no room and give nothing: they go, as the mix is measured in words. Rows of one
    doc_id, size and source share their copies: each gets as many, and the first ones, by place in the table, one
    more. Columns keep their names, whatever they are; an empty table gives an empty one.
    """
    plan = fair_mix(docs, **params).filter("size > 0").groupBy("doc_id", "size", _skey().alias("skey"))
    plan = written(plan.agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("n"), F.count(F.lit(1)).alias("rows")).filter("n > 0"), "copies")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    here = whole.select(
        "row", F.col("row.doc_id").cast("long").alias("id"), size_of(F.col("row.text")).alias("words"),
        F.coalesce(F.concat(F.lit("s"), F.col("row.source").cast("string")), F.lit("n")).alias("from"), F.monotonically_increasing_id().alias("at"),
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size")) & (F.col("from") == F.col("skey"))
    found = here.join(plan.hint("merge"), same)  # as many rows as documents, at every size
    alone = found.filter("rows = 1").select("row", F.col("n").alias("times"))
    # Repeated rows are numbered in two levels, within the slice of the table that `at` names, and over the slices.
    # They are written first: the numbers of a table that is computed twice could differ.
    shared_keys = written(plan.filter("rows > 1"), "repeated-keys")  # few or none: its size lets the join be a broadcast
    many = written(here.join(shared_keys, same).withColumn("slice", F.shiftright("at", 33)), "repeated")
    keys = ["id", "words", "from"]
    per = many.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("held"))
    below = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    lower = per.select(*[F.col(k).alias(f"l_{k}") for k in (*keys, "slice")], F.coalesce(F.sum("held").over(below), F.lit(0)).alias("lower"))
    met = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("words") == F.col("l_words")) & (F.col("from") == F.col("l_from")) & (F.col("slice") == F.col("l_slice"))
    place = F.col("lower") + F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("at"))
    shared = many.join(lower, met).withColumn("place", place)
    times = F.floor(F.col("n") / F.col("rows")) + F.when(F.col("place") <= F.col("n") % F.col("rows"), 1).otherwise(0)
    every = alone.unionByName(shared.select("row", times.alias("times")))
    return every.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")
