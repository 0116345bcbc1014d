"""Near-duplicate documents by SimHash fingerprints and tiled exact comparison.

Every distinct fingerprint stands in a tile of one population count. Two fingerprints within the radius have counts
that differ by the radius at most, so pairs of tiles further apart are never formed; the others are compared in full
with exclusive-or and bit counts, in blocks of bounded size. A pair of tiles reports its links as a forest (each
member with its root), so a group of n fingerprints costs n rows there, not n^2; the forests' components are the
classes. Equal fingerprints, a hot group of copies among them, are one entry from the start.

The number of comparisons is quadratic in the number of distinct fingerprints; tiles grow with it, up to a bound, so
that what is sent to the pairs of tiles stays small against the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._store import kept, scratch, written
from tidewire.llm._texts import texts
from tidewire.llm.components import connected_components

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: The smallest and largest tile, and how many tiles there are before they grow no more.
LEAST_TILE, MOST_TILE, TILES = 1024, 65_536, 16
#: Comparisons held in memory at once.
_BLOCK = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        hashes = np.array([digest(b" ".join(tokens), seed)], np.uint64)
    else:
        joined = memoryview(b" ".join(tokens))
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        first, last = (ends - lengths)[: len(tokens) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(marks)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, fp long")


def _root(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = parent[at]
    while (parent[at] != at).any():
        at = parent[at]
    return at


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and roots of the links between two tiles, or within one (b is None)."""
    every = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    parent = np.arange(len(every))
    height = max(1, _BLOCK // max(1, len(other)))
    for top in range(0, len(a), height):
        near = np.bitwise_count(a[top : top + height, None] ^ other[None, :]) <= radius
        for row in np.flatnonzero(near.sum(1) > (b is None)):  # in its own tile each row meets itself
            met = np.append(np.flatnonzero(near[row]) + shift, top + row)
            roots = np.unique(_root(parent, met))
            parent[roots] = roots[0]
            parent[met] = roots[0]
    roots = _root(parent, np.arange(len(every)))
    child = np.flatnonzero(roots != np.arange(len(every)))
    return every[child], every[roots[child]]


def fingerprint_links(marks: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp`, whose components are those of all pairs within the radius."""
    spark = marks.sparkSession
    counted = marks.select("fp", F.bit_count("fp").alias("ones"))
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    tile = tile or min(MOST_TILE, max(LEAST_TILE, sum(sizes.values()) // TILES))
    tiles_of = {c: -(-n // tile) for c, n in sizes.items()}
    if not sizes:
        return spark.createDataFrame([], "u long, v long")
    number = F.element_at(F.create_map(*[F.lit(x) for kv in tiles_of.items() for x in kv]), F.col("ones"))
    placed = counted.withColumn("part", F.pmod(F.xxhash64("fp"), number).cast("int"))
    tiles = written(placed.groupBy("ones", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = F.filter(F.sequence(F.col("a_ones"), F.col("a_ones") + radius), lambda c: c.isin(list(tiles_of)))
    parts = F.element_at(F.create_map(*[F.lit(x) for kv in tiles_of.items() for x in kv]), F.col("with_ones"))
    pairs = (
        tiles.withColumnsRenamed({"fps": "a", "ones": "a_ones", "part": "a_part"})
        .withColumn("with_ones", F.explode(near))
        .withColumn("with_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .filter("with_ones > a_ones or with_part >= a_part")
    )
    others = tiles.select(F.col("ones").alias("with_ones"), F.col("part").alias("with_part"), F.col("fps").alias("b"))
    both = pairs.join(others, ["with_ones", "with_part"]).select("a", "b", F.expr("a_ones = with_ones and a_part = with_part").alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(batch.column("a"), batch.column("b"), batch.column("same").to_pylist(), strict=True):
                x = a.values.to_numpy().view(np.uint64)
                u, v = tile_forest(x, None if same else b.values.to_numpy().view(np.uint64), radius)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return both.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Texts without words have fingerprint zero and are linked like any other. A null doc_id is never a component's
    id while the component has another; repeated rows come out as they came in. An empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    with scratch() as made:
        marks = kept(fingerprints(docs), "fingerprints", made)
        distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        links = written(fingerprint_links(distinct.select("fp"), radius), "links")
        roots = written(connected_components(links).select(F.col("node").alias("fp"), "root"), "component-roots")
        known = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        smallest = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
        of_mark = kept(known.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "mark-components", made)
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(of_mark, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
