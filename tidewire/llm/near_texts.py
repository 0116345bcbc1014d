"""Near copies of documents: word 5-shingles with a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints of 128 bits over each text's distinct shingles: texts of equal shingle sets
are one entry; entries are dealt into tiles of similar set sizes (sets as similar as that differ in size by a quarter
at most) and compared in full by exclusive-or and bit counts. At similarity 0.8 two fingerprints differ by 19 bits in
the mean, unrelated ones by 64, so a radius of 32 loses few pairs and links few strangers. Linked entries alone then
get their shingle sets (64-bit hashes), and a pair stays linked only if its sets are as similar as asked. Both steps
report links as forests: a group of n near copies costs n rows a pair of tiles, not n^2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._store import kept, scratch, written
from tidewire.llm._texts import texts
from tidewire.llm.components import connected_components
from tidewire.llm.simhash import LEAST_TILE, MOST_TILE, TILES, _root

SHINGLE, SEED, RADIUS, BITS = 5, 42, 32, 128
#: The similarity asked for, as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Sets below this size are that similar only if they are equal.
LEAST_SET = NUMERATOR
#: Bands of set sizes grow by a little more than 5 / 4, so that similar sets lie in one band or in neighbouring ones.
_BAND = math.log(1.26)
#: Linked entries whose sets are held against each other at once.
SET_TILE = 256
#: Comparisons held in memory at once.
_BLOCK = 1 << 19


def shingle_set(text: bytes) -> np.ndarray:
    """128-bit hashes (low and high word) of a text's distinct word shingles, in order; none for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty((0, 2), np.uint64)
    digest = xxhash.xxh3_128_digest
    if len(tokens) <= SHINGLE:
        found = {digest(b" ".join(tokens), SEED)}
    else:
        joined = memoryview(b" ".join(tokens))
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        first, last = (ends - lengths)[: len(tokens) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
        found = {digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)}
    hashes = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
    return hashes[np.argsort(hashes[:, 0])]


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """SimHash of a shingle set, as two words."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")
    return int(bits[0]), int(bits[1])


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of distinct numbers reach the similarity."""
    if NUMERATOR * max(len(x), len(y)) > DENOMINATOR * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, t, key, size, a, b): a hash of the text, the shingle set's key and size, and its fingerprint."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, a, b = [], [], [], []
            for text in texts(batch):
                hashes = shingle_set(text)
                low, high = sketch(hashes)
                keys.append(set_key(hashes))
                sizes.append(len(hashes))
                a.append(low)
                b.append(high)
            columns = [batch.column("doc_id"), batch.column("t"), _signed(keys), pa.array(sizes, pa.int64()), _signed(a), _signed(b)]
            yield pa.record_batch(columns, names=["doc_id", "t", "key", "size", "a", "b"])

    return _rows(docs).mapInArrow(of, "doc_id long, t long, key long, size long, a long, b long")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _sets(rows: DataFrame) -> DataFrame:
    """(key, hashes): the shingle set of each row's `text` as ordered 64-bit words in bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t) for t in texts(batch)]
            low = [np.ascontiguousarray(h[:, 0]).tobytes() for h in found]
            yield pa.record_batch([_signed([set_key(h) for h in found]), pa.array(low, pa.binary())], names=["key", "hashes"])

    return rows.select("text").mapInArrow(of, "key long, hashes binary")


def _near(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ c[None, :]) + np.bitwise_count(b[:, None] ^ d[None, :]) <= radius


def sketch_forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of members and roots of the links between two tiles (rows: key, a, b), or within one (y is None)."""
    every = x if y is None else np.concatenate([x, y], axis=1)
    other, shift = (x, 0) if y is None else (y, x.shape[1])
    parent = np.arange(every.shape[1])
    height = max(1, _BLOCK // max(1, other.shape[1]))
    for top in range(0, x.shape[1], height):
        near = _near(x[1, top : top + height], x[2, top : top + height], other[1], other[2], radius)
        for row in np.flatnonzero(near.sum(1) > (y is None)):  # in its own tile each row meets itself
            met = np.append(np.flatnonzero(near[row]) + shift, top + row)
            roots = np.unique(_root(parent, met))
            parent[roots] = roots[0]
            parent[met] = roots[0]
    roots = _root(parent, np.arange(every.shape[1]))
    child = np.flatnonzero(roots != np.arange(every.shape[1]))
    return every[0, child], every[0, roots[child]]


def set_forest(x: list[tuple], y: list[tuple] | None, radius: int) -> tuple[list[int], list[int]]:
    """Keys of members and roots of the similar pairs between two tiles of (key, a, b, set), or within one (y is None).

    Pairs that are connected already are not compared."""
    every = x if y is None else x + y
    a, b = (np.array([m[i] for m in every], np.uint64) for i in (1, 2))
    parent = list(range(len(every)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u, v = [], []
    for i in range(len(x)):
        start = i + 1 if y is None else len(x)
        near = _near(a[i : i + 1], b[i : i + 1], a[start:], b[start:], radius)[0]
        for j in (np.flatnonzero(near) + start).tolist():
            ri, rj = root(i), root(j)
            if ri != rj and similar(every[i][3], every[j][3]):
                parent[max(ri, rj)] = min(ri, rj)
                u.append(every[i][0])
                v.append(every[j][0])
    return u, v


def candidate_links(entries: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Edges (u, v) between keys of `entries` (key, size, a, b) whose components are those of all pairs within the
    radius and of similar sizes."""
    band = F.floor(F.ln("size") / _BAND).cast("int")
    banded = entries.filter(F.col("size") >= LEAST_SET).select("key", "a", "b", band.alias("band"))
    sizes = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a band
    if not sizes:
        return entries.sparkSession.createDataFrame([], "u long, v long")
    tile = tile or min(MOST_TILE, max(LEAST_TILE, sum(sizes.values()) // TILES))
    numbers = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // tile))])
    placed = banded.withColumn("part", F.pmod(F.xxhash64("key"), F.element_at(numbers, F.col("band"))).cast("int"))
    tiles = written(placed.groupBy("band", "part").agg(F.collect_list(F.struct("key", "a", "b")).alias("marks")), "sketch-tiles")
    near = F.filter(F.array(F.col("x_band"), F.col("x_band") + 1), lambda c: c.isin(list(sizes)))
    pairs = (
        tiles.withColumnsRenamed({"marks": "x", "band": "x_band", "part": "x_part"})
        .withColumn("with_band", F.explode(near))
        .withColumn("with_part", F.explode(F.sequence(F.lit(0), F.element_at(numbers, F.col("with_band")) - 1)))
        .filter("with_band > x_band or with_part >= x_part")
    )
    others = tiles.select(F.col("band").alias("with_band"), F.col("part").alias("with_part"), F.col("marks").alias("y"))
    both = pairs.join(others, ["with_band", "with_part"]).select("x", "y", F.expr("x_band = with_band and x_part = with_part").alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch.column("x"), batch.column("y"), batch.column("same").to_pylist(), strict=True):
                marks = [np.stack([t.values.field(i).to_numpy().view(np.uint64) for i in range(3)]) for t in ((x,) if same else (x, y))]
                u, v = sketch_forest(marks[0], None if same else marks[1], radius)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return both.mapInArrow(compare, "u long, v long")


def similar_links(members: DataFrame, radius: int = RADIUS, tile: int = SET_TILE, roots: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of `members` (root, key, a, b, hashes) of one root that
    are within the radius and similar. `roots` holds the members' roots where that is cheaper to read."""
    large = (members if roots is None else roots).groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")).filter("parts > 1")
    placed = members.join(written(large, "large-roots"), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    entry = F.struct("key", "a", "b", "hashes")
    tiles = written(placed.groupBy("root", "part").agg(F.first("parts").alias("parts"), F.collect_list(entry).alias("entries")), "set-tiles")
    # Roots of one tile, all but the largest, are compared in place; tiles of the others meet pair by pair.
    alone = tiles.filter("parts = 1").select(F.col("entries").alias("x"), F.when(F.lit(False), F.col("entries")).alias("y"), F.lit(True).alias("same"))
    several = tiles.filter("parts > 1")
    pairs = several.select("root", F.col("part").alias("x_part"), F.col("entries").alias("x"), F.explode(F.expr("sequence(part, parts - 1)")).alias("part"))
    both = pairs.join(several.select("root", "part", F.col("entries").alias("y")), ["root", "part"]).select("x", "y", F.expr("x_part = part").alias("same"))
    both = alone.unionByName(both)

    def rows(tile: pa.Scalar) -> list[tuple]:
        return [(m["key"], m["a"] % 2**64, m["b"] % 2**64, np.frombuffer(m["hashes"], "<u8")) for m in tile.as_py()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch.column("x"), batch.column("y"), batch.column("same").to_pylist(), strict=True):
                u, v = set_forest(rows(x), None if same else rows(y), radius)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.mapInArrow(compare, "u long, v long")


def near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: doc_id, component_id (smallest doc_id that chains of similar texts reach).

    Null and empty texts have no words; those without words are one component. A null doc_id is never a component's
    id while the component has another. Repeated rows come out as they came in; an empty table gives an empty result;
    columns other than doc_id and text are ignored."""
    marks, of_key = _components(docs, radius)
    return marks.select("doc_id", "key").join(of_key, "key").select("doc_id", F.col("first.doc_id").alias("component_id"))


def _components(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (key, first): the component's first text, by doc_id (null last), hash and key.

    Both are written; all that leads to them is dropped."""
    with scratch() as made:
        marks = kept(sketches(docs), "sketches", made)
        texts_of = marks.groupBy("key", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("a").alias("a"), F.first("b").alias("b"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "n")).alias("least")
        entries = written(texts_of.groupBy("key").agg(least, F.first("size").alias("size"), F.first("a").alias("a"), F.first("b").alias("b")), "sketch-entries")
        linked = connected_components(written(candidate_links(entries, radius), "sketch-links"))
        members = written(entries.join(linked.select(F.col("node").alias("key"), "root"), "key"), "linked")
        # Written first: where few texts are linked, their small table is broadcast and no text moves.
        wanted = written(members.select(F.col("least.doc_id").alias("id"), F.col("least.t").alias("mark")).distinct(), "linked-texts")
        whole = _rows(docs)
        sets = _sets(whole.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("mark")), "left_semi")).dropDuplicates(["key"])
        links = written(similar_links(members.select("root", "key", "a", "b").join(sets, "key"), radius, roots=members), "similar-links")
        roots = connected_components(links).select(F.col("node").alias("key"), "root")
        known = written(entries.select("key", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "near-roots")
        first = F.min(F.struct("least.none", "least.doc_id", "least.t", "least.n", "key")).alias("first")
        smallest = known.groupBy("root").agg(first)
        return marks, kept(known.select("key", "root").join(smallest, "root").select("key", "first"), "near-ids", made)


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of `docs` for each component of near copies: of smallest doc_id (null last), then of smallest hash of
    the text; all columns stay, whatever their names.

    Of rows repeated with one doc_id and text one stays, whose other columns sort first as JSON. An empty table gives
    an empty one.
    """
    of_key = _components(docs, radius)[1]
    stays = of_key.filter("key = first.key").select(F.col("first.doc_id").alias("id"), F.col("first.t").alias("mark"), F.col("first.n").alias("n"))
    repeats = written(stays.filter("n > 1"), "repeated-texts")  # few or none: its size lets the join be a broadcast
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    here = whole.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("t"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("mark"))
    alone = here.join(stays.filter("n = 1").hint("merge"), same, "left_semi").select("row")
    repeated = here.join(repeats, same, "left_semi")
    order = Window.partitionBy("doc_id", "t").orderBy(F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256), F.to_json("row"))
    one = repeated.withColumn("place", F.row_number().over(order)).filter("place = 1").select("row")
    return alone.unionByName(one).select("row.*")
