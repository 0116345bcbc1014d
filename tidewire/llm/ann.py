"""Approximate nearest neighbours by inner product: an NN-descent graph, searched greedily.

The graph starts from blocks of random hyperplanes. A round gathers, by joins, the neighbours and reverse neighbours
of every vector and compares those pairs (neighbours of a common neighbour) of which one is new there, keeping what
beats a list's last. A search starts at a query's own neighbours and follows the graph from the best found so far, a
beam a hop. Equal vectors are one node, with its smallest ids. Graph and search compare vectors in bytes, one scale a
vector; the best of each search are scored again from the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._store import kept, scratch, written

NEAREST, DEGREE, REVERSE, ROUNDS, STARTS, BLOCK = 20, 32, 32, 4, 4, 400
BEAM, HOPS, PARTNERS, RESCORED = 256, 4, 10, 3
#: Members compared with one another at once; larger start blocks are dealt into parts of about this size.
PART = 1024
#: Rows of a search step scored at once.
SLICE = 512
#: At most so many large blocks are broadcast; more are joined by shuffle.
BROADCAST_BLOCKS = 100_000
_EDGE = "u long, v long, s double"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, e) in double: rows with an id and a vector that is neither null nor zero, all components finite."""
    x = F.transform("embedding", lambda a: a.cast("double"))
    fine = F.forall("e", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("e", lambda a: a != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("e"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(fine)


def nodes(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """(id, ids, e): each distinct vector, its smallest id and its k + 1 smallest ids.

    The limit on row_number is taken in each input partition before the shuffle, so many copies stay cheap.
    """
    place = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    few = rows.distinct().withColumn("r", place).filter(F.col("r") <= k + 1)
    return few.groupBy("e").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def coded(known: DataFrame) -> DataFrame:
    """(id, code, dims): the scale as a double, then a signed byte for each component; zeros follow shorter vectors."""
    most = known.agg(F.max(F.size("e"))).collect()[0][0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dims = b.column("e").value_lengths().to_numpy()
                x = np.zeros((b.num_rows, most))
                x[np.arange(most)[None, :] < dims[:, None]] = b.column("e").flatten().to_numpy(zero_copy_only=False)
                scale = np.abs(x).max(axis=1) / 127
                scale = np.where(scale > 0, scale, np.abs(x).max(axis=1))  # the least doubles, divided, are 0
                parts = np.rint(x / scale[:, None]).astype(np.int8)
                code = [s.tobytes() + p.tobytes() for s, p in zip(scale.astype("<f8"), parts, strict=True)]
                yield pa.record_batch([b.column("id"), pa.array(code, pa.binary()), pa.array(dims.astype(np.int32))], names=["id", "code", "dims"])

    return known.select("id", "e").mapInArrow(run, "id long, code binary, dims int")


def _decoded(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scales and components of codes of one length, at least one."""
    at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(codes), -1)
    return raw[:, :8].copy().view("<f8").ravel(), raw[:, 8:].view(np.int8)


def best(edges: DataFrame, k: int, by: str = "u") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("s"), "u", "v")
    return edges.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _merged(old: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k best of both for each u, each once; fresh where not in `old`. One shuffle, by u."""
    both = old.select("u", "v", "s", F.lit(False).alias("fresh")).unionByName(found.select("u", "v", "s", F.lit(True).alias("fresh")))
    once = both.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.bool_and("fresh").alias("fresh"))
    return best(once, k)


def _last(lists: DataFrame, k: int) -> DataFrame:
    """(id, bar): what a new member of u's list has to beat, where the list is full."""
    return lists.groupBy(F.col("u").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).alias("bar"))


def _meet(groups: DataFrame, partners: int) -> DataFrame:
    """Edges from each member of a group (g, id, code, bar, fresh) to its best partners there that beat its bar.

    Of a pair one member at least is fresh. Groups pass in pieces of PART.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scale, x = _decoded(batch.column("code"))
            bar = batch.column("bar").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            now = [batch.column("g").to_numpy(), batch.column("id").to_numpy(), scale, x, bar, batch.column("fresh").to_numpy(zero_copy_only=False)]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            cut = np.flatnonzero(np.diff(now[0])) + 1
            last = cut[-1] if len(cut) else 0
            yield from compare(*(p[:last] for p in now))
            held = [p[last:] for p in now]
        if held is not None:
            yield from compare(*held)

    def compare(g, ids, scale, x, bar, fresh):
        out = [[], [], []]
        bounds = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, z in zip(bounds, bounds[1:], strict=False):
            for i in range(a, z, PART):
                part = slice(i, min(z, i + PART))
                own, new, least, size = ids[part], fresh[part], bar[part], scale[part]
                if len(own) < 2 or not new.any():
                    continue
                y = x[part].astype(np.float32)
                s = (y @ y.T) * size[:, None] * size[None, :]
                s[(own[:, None] == own[None, :]) | ~(new[:, None] | new[None, :]) | ~(s > least[:, None])] = -np.inf
                k = min(partners, len(own) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(s, top, 1)
                row, col = np.nonzero(value > -np.inf)
                out[0].append(own[row])
                out[1].append(own[top[row, col]])
                out[2].append(value[row, col])
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(p)) for p in out], names=["u", "v", "s"])

    dealt = groups.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, _EDGE)


def build_graph(codes: DataFrame, n: int, dims: int) -> DataFrame:
    """(u, v, s, fresh): the DEGREE best neighbours found of each node of `codes` (id, code, dims).

    Blocks hold vectors of one length, so no edge joins different ones."""
    bits = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    planes = np.random.default_rng(11).standard_normal((STARTS, bits, dims)).astype(np.float32)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _decoded(batch.column("code"))[1].astype(np.float32)
            for r in range(STARTS):
                mark = ((x @ planes[r].T) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                yield pa.record_batch([pa.array((mark * STARTS + r).astype(np.int64)), *batch.columns], names=["g", "id", "code", "dims"])

    blocks = codes.mapInArrow(block, "g long, id long, code binary, dims int")
    starts = _in_parts(blocks.select(F.xxhash64("g", "dims").alias("g"), "id", "code"))
    starts = starts.select("g", "id", "code", F.lit(None).cast("double").alias("bar"), F.lit(True).alias("fresh"))
    first = _meet(starts, DEGREE)
    graph = written(_merged(first.limit(0), first, DEGREE), "graph")
    for _ in range(ROUNDS):
        own = codes.select(F.col("id").alias("g"), "id", F.lit(False).alias("fresh"))
        members = both_ways(graph).select(F.col("u").alias("g"), F.col("v").alias("id"), "fresh").unionByName(own)
        barred = codes.join(_last(graph, DEGREE), "id", "left")
        found = _meet(members.join(barred, "id").select("g", "id", "code", "bar", "fresh"), PARTNERS)
        graph = written(_merged(graph, found, DEGREE), "graph")
    return graph


def _in_parts(starts: DataFrame) -> DataFrame:
    """Blocks larger than PART, dealt at random into parts of about that size: no task holds a crowded block."""
    large = starts.groupBy("g").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > PART)
    large = written(large, "blocks")
    if large.count() <= BROADCAST_BLOCKS:
        large = F.broadcast(large)
    parts = F.ceil(F.coalesce("members", F.lit(1)) / PART)
    dealt = F.xxhash64("g", F.pmod(F.xxhash64("id", "g"), parts))
    return starts.join(large, "g", "left").withColumn("g", dealt).drop("members")


def both_ways(graph: DataFrame) -> DataFrame:
    """The graph and its reverse, the REVERSE best a node; fresh where every direction of it is."""
    back = best(graph, REVERSE, "v").select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh")
    return graph.unionByName(back).groupBy("u", "v").agg(F.max("s").alias("s"), F.bool_and("fresh").alias("fresh"))


def _inner(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def search(graph: DataFrame, codes: DataFrame, asked: DataFrame) -> DataFrame:
    """(u, v, s): the BEAM best found of each node of `asked` (id).

    A node's neighbours travel with it, codes and all (DEGREE + REVERSE at most), so a step is one join of the beam's
    fresh members with them; only what beats the beam's last leaves it.
    """
    named = codes.select(F.col("id").alias("w"), F.col("code").alias("w_code"))
    around = both_ways(graph).select("u", F.col("v").alias("w")).join(named, "w")
    around = around.groupBy(F.col("u").alias("v")).agg(F.collect_list(F.struct("w", "w_code")).alias("near"))
    around = written(around.select("v", F.col("near.w").alias("ws"), F.col("near.w_code").alias("codes")), "around")
    asked = written(codes.join(asked, "id", "left_semi"), "asked")
    beam = written(graph.select("u", "v", "s", F.lit(True).alias("fresh")).join(asked.select(F.col("id").alias("u")), "u", "left_semi"), "beam")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                q_scale, q = _decoded(b.column("q"))
                w_scale, w = _decoded(b.column("codes").flatten())
                row = np.repeat(np.arange(b.num_rows), b.column("ws").value_lengths().to_numpy())
                u, v = b.column("u").to_numpy()[row], b.column("ws").flatten().to_numpy()
                s = np.einsum("ij,ij->i", q.astype(np.float32)[row], w.astype(np.float32)) * q_scale[row] * w_scale
                bar = b.column("bar").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                fine = (u != v) & (s > bar[row])
                yield pa.record_batch([pa.array(u[fine]), pa.array(v[fine]), pa.array(s[fine])], names=["u", "v", "s"])

    for _ in range(HOPS):
        wanted = asked.join(_last(beam, BEAM), "id", "left").select(F.col("id").alias("u"), F.col("code").alias("q"), "bar")
        front = beam.filter("fresh").select("u", "v").join(wanted, "u").join(around, "v").select("u", "q", "bar", "ws", "codes")
        beam = written(_merged(beam, front.mapInArrow(score, _EDGE), BEAM), "beam")
    return beam


def nearest(embeddings: DataFrame, every: int = 20, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score for each vec_id divisible by `every`: its k nearest found, itself left out.

    Null, zero and non-finite vectors take no part, nor a null vec_id. An inner product needs one length: a query's
    candidates are the vectors of its own length. Ties go to the smaller vec_id. Every query has its rows, in groups
    of any number of equal vectors too. Rows repeated as a whole count once. An empty table gives an empty result;
    columns other than vec_id and embedding are ignored.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    with scratch() as made:
        known = written(nodes(rows, k), "nodes")
        n, dims = known.agg(F.count(F.lit(1)), F.max(F.size("e"))).collect()[0]
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        codes = written(coded(known), "codes")
        graph = build_graph(codes, n, dims)
        codes = codes.drop("dims")
        # Every query of a group of equal vectors, however many: a crowded vector's rows are split by the skew join.
        queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "e").distinct()
        queries = written(queries.join(known.select("e", F.col("id").alias("u")), "e").select("query_id", "u"), "queries")
        asked = queries.select(F.col("u").alias("id")).distinct()
        short = best(search(graph, codes, asked), RESCORED * k).select("u", "v").unionByName(asked.select(F.col("id").alias("u"), F.col("id").alias("v")))
        left = known.select(F.col("id").alias("u"), F.col("e").alias("a"))
        right = known.select(F.col("id").alias("v"), F.col("ids").alias("vec_ids"), F.col("e").alias("b"))
        exact = short.join(left, "u").join(right, "v").select("u", "vec_ids", _inner(F.col("a"), F.col("b")).alias("score"))
        exact = exact.select("u", F.explode("vec_ids").alias("vec_id"), "score")
        place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "vec_id"))
        first = exact.withColumn("r", place).filter(F.col("r") <= k + 1)  # one more: a query leaves itself out
        lists = first.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
        others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
        out = queries.join(lists, "u").select("query_id", F.posexplode(others).alias("at", "c"))
        out = out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))
        return kept(out, "nearest", made)
