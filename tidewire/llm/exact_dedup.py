"""Exact deduplication by content sort, in DataFrame functions only.

Rows are sorted by their normalised bytes: the first LEAD characters, then, as splitters must be of bounded length,
by SHA-256 and the bytes themselves, then by doc_id. Sampled splitters of that order range-partition the rows; each
range is sorted on disk where need be, equal texts stand side by side, and a row starts a group when its whole text
differs from its neighbour's. Splitters hold the doc_id too, so a group with a third of all rows spreads over many
ranges; the groups at the ranges' edges are then compared, text by text, with those of the next range, and chains of
them become one.

Text crosses the network once. What the driver sees: 16 keys of bounded length a range, at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._ranges import default_ranges, range_bucket, sortable, split_points
from tidewire.llm._store import kept, scratch, written

#: Characters of a text that the splitters hold.
LEAD = 64
#: Every run of ASCII white space that is not already one space.
_ODD_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ODD_RUN, " ")


def _lead(norm: Column) -> Column:
    """Leading bytes as hexadecimal digits, which sort like the bytes, and the digest of the whole."""
    return F.concat(F.hex(F.encode(F.substring(norm, 1, LEAD), "UTF-8")), F.lit("!"), F.sha2(norm, 256))


def _content_sorted(docs: DataFrame, n_ranges: int | None, stage: bool) -> tuple[DataFrame, DataFrame]:
    """Rows in content order, with their group (p, g) in their range, and the chains of groups over ranges.

    A stage carries whole rows (`row`), of those only that may stay; the text travels as the sort's key, and as
    it was only where that differs.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or default_ranges(spark)
    order = F.concat(_lead(normalised(F.col("text"))), sortable(F.col("doc_id").cast("long")))
    splitters = split_points(docs.select("doc_id", "text"), order, n_ranges)
    norm = normalised(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), *_payload(docs, norm, stage))
    keyed = base.withColumn("lead", _lead(F.col("norm")))
    keyed = keyed.withColumn("p", range_bucket(F.concat("lead", sortable(F.col("doc_id"))), splitters))
    keyed = keyed.select("p", F.substring("norm", 1, LEAD).alias("lead"), F.substring_index("lead", "!", -1).alias("text_sha256"), "norm", "doc_id", "others", "raw")
    in_order = Window.partitionBy("p").orderBy("lead", "text_sha256", "norm", F.col("doc_id").asc_nulls_last(), "others")
    neighbours = keyed.select("*", F.row_number().over(in_order).alias("rn"), F.lag("norm").over(in_order).alias("before"), F.lead("norm").over(in_order).alias("after"))
    starts = ~F.col("norm").eqNullSafe(F.col("before"))
    marked = written(
        neighbours.select(
            "doc_id", "p", "rn", "text_sha256", starts.alias("starts"), F.col("after").isNull().alias("last"),
            F.when(F.col("before").isNull() | F.col("after").isNull(), F.col("norm")).alias("edge"),
            F.when(starts & stage, F.struct("others", "norm", "raw")).alias("kept_row"),
        ),
        "content-sort",
    )
    numbered = marked.withColumn("g", F.sum(F.col("starts").cast("long")).over(Window.partitionBy("p").orderBy("rn")))
    group = Window.partitionBy("p", "g")
    local = numbered.select(
        "doc_id", "p", "g", "rn", "text_sha256", "starts", "last", "edge",
        F.first("doc_id").over(group.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head"),
        F.count(F.lit(1)).over(group).alias("size"),
    )
    with scratch() as made:
        chains = kept(_chains(local), "chains", made)
    return (marked if stage else local), chains


def _payload(docs: DataFrame, norm: Column, stage: bool) -> list[Column]:
    """`others`: a row's columns but the text; `raw`: its text where that is null or not as normalised."""
    if not stage:
        return [F.lit(None).cast("string").alias("others"), F.lit(None).cast("string").alias("raw")]
    others = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row"))
    return [others.alias("others"), F.when(F.col("text") != norm, F.col("text")).alias("raw")]


def exact_groups(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and blank-free empty texts form one group. A null doc_id sorts after all
    others; if a group has no other, keep_id is null. Of repeated rows with one doc_id and text, one is kept.
    An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    local, fixed = _content_sorted(docs, n_ranges, stage=False)
    joined = local.drop("edge", "last").join(F.broadcast(fixed), ["p", "g"], "left")  # two groups a range at most
    return joined.select(
        "doc_id",
        F.when(F.col("chained"), F.col("chain_head")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        (F.col("starts") & F.coalesce("first_of_chain", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _chains(local: DataFrame) -> DataFrame:
    """Of the groups at the edges of ranges, those that go on in the next range: (p, g) and what holds for the whole.

    Works on one row a range, but for the texts at the edges, which are compared by a join on the range's number.
    """
    edges = local.filter((F.col("rn") == 1) | F.col("last"))
    per_range = edges.groupBy("p").agg(
        F.max(F.struct("rn", "g", "head", "size", "edge")).alias("z"), F.min(F.struct("rn", "g", "head", "size", "edge")).alias("a")
    )
    row = written(
        per_range.select(
            "p", F.col("z.g").alias("g"), F.col("z.head").alias("z_head"), F.col("z.size").alias("z_size"), F.col("z.edge").alias("z_edge"),
            F.col("a.head").alias("a_head"), F.col("a.size").alias("a_size"), F.col("a.edge").alias("a_edge"),
        ),
        "range-edges",
    )
    order = Window.orderBy("p")
    before = row.select("p").select("p", F.lag("p").over(order).alias("prev"))
    texts = row.select(F.col("p").alias("prev"), F.col("z_edge").alias("prev_edge"))
    goes_on = (
        row.select("p", "a_edge").join(before, "p").join(texts, "prev")
        .select("p", (F.col("a_edge") == F.col("prev_edge")).alias("goes_on"))
    )
    flat = row.drop("z_edge", "a_edge").join(goes_on, "p", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    chain = F.sum(F.when((F.col("g") == 1) & F.col("goes_on"), 0).otherwise(1)).over(order)
    flat = flat.withColumn("chain", chain)
    flat = flat.withColumn("prev_chain", F.lag("chain").over(order))
    member = F.explode(
        F.array(
            F.struct(F.col("g"), F.col("chain"), F.col("z_head").alias("head"), F.col("z_size").alias("size")),
            F.struct(
                F.lit(1).cast("long").alias("g"), F.when(F.col("goes_on") & (F.col("g") > 1), F.col("prev_chain")).alias("chain"),
                F.col("a_head").alias("head"), F.col("a_size").alias("size"),
            ),
        )
    )
    members = flat.select("p", member.alias("m")).select("p", "m.*").filter("chain is not null")
    whole = Window.partitionBy("chain")
    first = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        members.select(
            "p", "g", F.count(F.lit(1)).over(whole).alias("n"), F.sum("size").over(whole).alias("chain_size"),
            F.first("head").over(first).alias("chain_head"), (F.row_number().over(whole.orderBy("p")) == 1).alias("first_of_chain"),
        )
        .filter("n > 1").drop("n").withColumn("chained", F.lit(True))
    )


def drop_exact_copies(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Of each group of equal texts the row of smallest doc_id (null last); all columns stay, whatever their names.

    Null text equals empty text. Of repeated rows with one doc_id and text, the one whose other columns sort first
    stays, so a computation done again chooses alike; those columns must have an order (no maps). An empty table gives
    an empty one.
    """
    marked, fixed = _content_sorted(docs, n_ranges, stage=True)
    later = fixed.filter(~F.col("first_of_chain") & (F.col("g") == 1)).select("p")  # ranges that begin inside a group
    stays = marked.filter("starts").join(F.broadcast(later.withColumn("rn", F.lit(1))), ["p", "rn"], "left_anti")
    text = F.when(F.col("kept_row.others.no_text"), F.lit(None)).otherwise(F.coalesce("kept_row.raw", "kept_row.norm"))
    columns = [text.alias(c) if c.lower() == "text" else F.col(f"kept_row.others.row.`{c}`").alias(c) for c in docs.columns]
    return stays.select(*columns)
