"""Prefix tries of conversations, built level by level.

Level d + 1 groups the live conversations by their node at depth d and their next turn; a node is known by its depth
and its smallest member. A node whose members are all equal to their ends (one conversation, or copies of one) is
settled: below it lies a chain, written out by expression, so the loop runs only as deep as conversations part. Then
the levels are joined in reverse, and each node adds up its children's leaves and savings. Each level is a written
table; nothing but a count of rows comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._store import Table, kept, scratch, written

#: Conversations of one base share up to HEADS - 1 of its first turns; bases are the ids divisible by FAMILY.
FAMILY, HEADS = 20, 4
#: Turns are numbered in blocks of so many turn numbers, and members joined in blocks of so many conv_ids.
BLOCK = 1024
#: A node of at least this part of a level's conversations is joined by broadcast: at most so many nodes are.
HEAVY = 1000
_NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words, cum): each row's place in its conversation from 1, the SHA-256 of its role and text,
    its words, and the words up to it.

    Order is by turn, null first; rows of one turn go by role, then key. Null role and text are empty; rows without a
    conv_id belong to no conversation and are left out; repeated rows are turns of their own. Long conversations are
    numbered in blocks of turn numbers, so none is in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "w")])
    rows = rows.withColumns({"at": F.row_number().over(inside), "sum": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("n") + F.col("at")).alias("pos"), "key", "words", (F.col("w") + F.col("sum")).alias("cum"))


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns, and one row a conversation: (conv_id, len, total).

    Conversation c gets the first h = crc32(c) % 4 turns of conversation c - c % 20, then its own after the first h.
    """
    upto = [F.max(F.when(F.col("pos") <= k, F.col("cum"))) for k in range(1, HEADS)]
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("len"), F.max("cum").alias("total"), F.array(F.lit(0).cast("long"), *[F.coalesce(c, F.lit(0)) for c in upto]).alias("upto"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    h = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    bases = own.filter(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"), F.col("upto").alias("base_upto"))
    plan = own.withColumn("base", base).withColumn("h", h).join(bases, "base", "left")
    plan = plan.withColumns({"head": F.least("h", F.coalesce("base_len", F.lit(0))), "skip": F.least("h", "len")})
    more = F.when(F.col("head") > 0, F.element_at("base_upto", (F.col("head") + 1).cast("int"))).otherwise(0) - F.element_at("upto", (F.col("skip") + 1).cast("int"))
    plan = plan.select("conv_id", "base", "head", "skip", more.alias("more"), (F.col("head") + F.col("len") - F.col("skip")).alias("len"), (F.col("total") + more).alias("total"))
    plan = written(plan, "plan")
    tails = turns.join(plan.select("conv_id", "head", "skip", "more"), "conv_id").filter("pos > skip")
    tails = tails.select("conv_id", (F.col("pos") - F.col("skip") + F.col("head")).alias("pos"), "key", "words", (F.col("cum") + F.col("more")).alias("cum"))
    first = turns.filter((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    heads = first.join(plan.filter("head > 0").select("conv_id", "base", "head"), "base").filter("pos <= head").select("conv_id", "pos", "key", "words", "cum")
    return tails.unionByName(heads), plan.select("conv_id", "len", "total")


def _same(mark: str) -> Column:
    return (F.min(mark) == F.max(mark)).alias("same")


def _of_nodes(step: DataFrame, nodes: DataFrame, n_live: int) -> DataFrame:
    """Each conversation of a level with its node's columns; the few nodes that hold many conversations by broadcast."""
    on = ["parent", "key"]
    found = nodes.select(*on, F.col("conv_id").alias("node"), "same", (F.col("n_convs") >= n_live / HEAVY).alias("heavy"))
    heavy = found.filter("heavy").drop("heavy")  # HEAVY nodes at most
    light = found.filter("not heavy").drop("heavy")
    left = step.join(F.broadcast(heavy), on, "left")
    own = ["conv_id", "mark", "len", "total", "node", "same"]
    rest = left.filter("node is null").drop("node", "same").join(light, on)
    return left.filter("node is not null").select(own).unionByName(rest.select(own))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's members, whose blocks come one after another; a running hash is all that is held."""
    now, digest, out = None, None, []
    for batch in batches:
        for depth, node, ids in zip(batch.column("depth").to_pylist(), batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if now != (depth, node):
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, node), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _hash_rows(out)
        out = []
    if now is not None:
        yield _hash_rows([(*now, digest.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "node", "ends_sha256"])


def member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): ids ascending, comma-joined, hashed.

    Ids are joined in blocks first, so a node that holds a third of all conversations reaches its task as one row for
    BLOCK of them; a hash is of one stream, so that task reads them in order.
    """
    blocks = ends.groupBy("depth", "node", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("depth", "node", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return blocks.repartition("depth", "node").sortWithinPartitions("depth", "node", "block").mapInArrow(_hashes, "depth long, node long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; the root is the textless node of depth 0.

    `turns` has (conv_id, pos from 1 without gaps, key, words, cum), `convs` a row a conversation (conv_id, len, total):
    those without turns are members of the root alone. No conversations give no node.
    """
    with scratch() as made:
        return _trie(turns, convs, made)


def _trie(turns: DataFrame, convs: DataFrame, made: list[Table]) -> DataFrame:
    turns = written(turns.repartition("conv_id").sortWithinPartitions("pos"), "turns")
    marks = turns.groupBy("conv_id").agg(*[F.bit_xor(F.xxhash64("pos", "key", F.lit(seed))).alias(f"m{seed}") for seed in (1, 2)])
    live = convs.join(marks, "conv_id", "left").select("conv_id", F.struct("len", F.coalesce("m1", F.lit(0)).alias("m1"), F.coalesce("m2", F.lit(0)).alias("m2")).alias("mark"), "len", "total")
    levels, ends, depth = [], [], 0
    step = written(live.select(F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("cum"), "*"), "step-0")
    while True:
        nodes = step.groupBy("parent", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), _same("mark"), *[F.max(c).alias(c) for c in ("words", "cum", "len", "total")])
        nodes = written(nodes, f"nodes-{depth}")
        levels.append(nodes)
        if depth:
            members = _of_nodes(step, nodes, step.count())
        else:
            root = nodes.first() or {"conv_id": 0, "same": True}  # one row, or none of an empty table
            members = step.select("conv_id", "mark", "len", "total", F.lit(root["conv_id"]).cast("long").alias("node"), F.lit(root["same"]).alias("same"))
        members = written(members, f"members-{depth}")
        ends.append(members.filter(F.col("same") | (F.col("len") == depth)).select(F.col("len").alias("depth"), "node", "conv_id"))
        live = members.filter(~F.col("same") & (F.col("len") > depth)).select("conv_id", F.col("node").alias("parent"), "mark", "len", "total")
        if live.isEmpty():
            break
        depth += 1
        step = written(live.join(turns.filter(F.col("pos") == depth).select("conv_id", "key", "words", "cum"), "conv_id"), f"step-{depth}")
    rows, below = [], None
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        if below is not None:
            kids = below.groupBy("parent_conv_id").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            level = level.join(kids, level.conv_id == kids.parent_conv_id, "left").drop("parent_conv_id")
        else:
            level = level.select("*", *[F.lit(None).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        chain = F.when(F.col("same"), (F.col("n_convs") - 1) * (F.col("total") - F.col("cum"))).otherwise(0)
        below = level.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
            F.coalesce("kids", (F.col("same") & (F.col("len") > depth)).cast("long")).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", chain)).alias("saved_tokens"),
        )
        below = written(below, f"sums-{depth}")
        rows.append(below)
        settled = levels[depth].filter(F.col("same") & (F.col("len") > depth)).select("conv_id", F.lit(depth).alias("from"), "n_convs", "len", "total")
        levels[depth] = settled
    settled = levels[0]
    for level in levels[1:]:
        settled = settled.unionByName(level)
    chains = turns.join(settled, "conv_id").filter(F.col("pos") > F.col("from")).select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_convs", (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * (F.col("total") - F.col("cum") + F.col("words"))).alias("saved_tokens"),
    )
    for level in rows:
        chains = chains.unionByName(level)
    ended = ends[0]
    for part in ends[1:]:
        ended = ended.unionByName(part)
    hashes = member_hashes(ended).withColumnRenamed("node", "conv_id")
    out = chains.join(hashes, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_IDS)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return kept(out.select(names), "trie", made)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (with_shared_heads). Nulls, ties and repeated rows go as in numbered_turns; an
    empty table gives an empty one; columns other than conv_id, turn, role and text are ignored."""
    with scratch() as made:
        return _trie(*with_shared_heads(written(numbered_turns(conversations), "numbered")), made)
