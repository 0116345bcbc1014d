"""Line deduplication within a bound of one edit, by a deletion-neighbourhood join.

A line's neighbourhood is the line itself and the line with any one unit left out, as hashed keys. Two lines of equal
length that differ in one unit share the key of that unit's place left out; a line with one unit more shares the
shorter one's own key. Units are words for lines of WORDS words on, characters for shorter lines: the bound is one in
eight words, or one in LEAST_CHARS characters. Keys are joined by their smallest member, never pair by pair: within a
key and place every member is in the bound of the first, so a template line with many fillings costs one row each.
Edit distance is verified on the texts. A line goes if an earlier one (by doc_id, then line) equals it or is within
the bound.

Only lines that can have a neighbour emit their keys: one edit leaves the first or the second half of a line as it
was, so a line whose halves meet no other line's is out. That test loses nothing and spares most lines. The keys of
halves that meet are marked in a bit map of bounded size, which goes to all tasks: a second pass over the texts emits
the lines that it marks. Once it is crowded it marks more lines than need be, which the joins sort out; nothing is
lost. So every exchange moves hashes, and of texts only marked lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._store import Table
from tidewire.llm._texts import texts

#: From so many words on a line may differ in a word; shorter ones in a character, from so many characters on.
WORDS, LEAST_CHARS = 8, 20
_MIX = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1
#: Bits of the map for each key of a half that meets another line's, and at most: 64 MB.
BITS_A_KEY, MOST_BITS = 64, 1 << 29
_CHUNK = 1 << 16


def line_words(line: bytes) -> list[bytes]:
    return line.split()


def views(line: bytes) -> list[tuple[int, list[bytes]]]:
    """(kind, units) in which a line may have neighbours: 0 words, 1 characters.

    A line of one word less than WORDS has both, as a line of WORDS words may be one word more.
    """
    words, out = line.split(), []
    if len(words) >= WORDS - 1:
        out.append((0, words))
    if len(words) < WORDS:
        chars = [c.encode() for c in b" ".join(words).decode()]
        if len(chars) >= LEAST_CHARS - 1:
            out.append((1, chars))
    return out


def half_keys(kind: int, units: list[bytes]) -> list[int]:
    """Keys of the halves of a line, and of the halves that it would share with a line of one unit more."""
    n, out, glue = len(units), [], b"" if kind else b" "
    for length in (n, n + 1):
        cut = length // 2
        head, tail = glue.join(units[:cut]), glue.join(units[n - (length - cut) :])
        out += [xxhash.xxh64_intdigest(head, 4 * length + 2 * kind), xxhash.xxh64_intdigest(tail, 4 * length + 2 * kind + 1)]
    return out


def neighbourhood(tokens: list[bytes]) -> tuple[int, list[int]]:
    """Key of the line as it is, and the keys with each word left out, by one sum of weighted word hashes."""
    hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in tokens], np.uint64)
    power = np.cumprod(np.full(len(tokens) + 1, _MIX | 1, np.uint64))
    as_is, moved = hashes * power[:-1], hashes[1:] * power[: len(tokens) - 1]
    before = np.concatenate([[np.uint64(0)], np.cumsum(as_is)])
    after = np.concatenate([np.cumsum(moved[::-1])[::-1], [np.uint64(0)]])
    return int(before[-1]), (before[:-1] + after).tolist()


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, removed or replaced, at most, makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i:] == long[i + 1 :] or (len(a) == len(b) and short[i + 1 :] == long[i + 1 :])


def near_lines(a: bytes, b: bytes) -> bool:
    """Whether two lines are within one edit: of a word if the longer has WORDS words, of a character if both have less."""
    x, y = dict(views(a)), dict(views(b))
    if 0 in x and 0 in y and max(len(x[0]), len(y[0])) >= WORDS and within_one(x[0], y[0]):
        return True
    return 1 in x and 1 in y and max(len(x[1]), len(y[1])) >= LEAST_CHARS and within_one(x[1], y[1])


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, d, t, text): d is doc_id with null last, t a hash that tells rows of one d apart."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("d"), F.xxhash64(text, doc_id.isNull()).alias("t"), text.alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that few lines are held as objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lines(docs: DataFrame) -> DataFrame:
    """A row a non-blank line: its place (d, t, p), 128 bits of its words, and its half keys."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for d, t, text in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), texts(batch), strict=True):
                for p, line in enumerate(text.split(b"\n")):
                    words = line.split()
                    if not words:
                        continue
                    both = xxhash.xxh3_128_intdigest(b" ".join(words))
                    keys = [_signed(k) for kind, units in views(line) for k in half_keys(kind, units)]
                    for column, value in zip(out, (d, t, p, _signed(both >> 64), _signed(both), keys), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["d", "t", "p", "h1", "h2", "ks"])

    return _rows(docs).select("d", "t", "text").mapInArrow(split, "d long, t long, p int, h1 long, h2 long, ks array<long>")


def _met(keys: DataFrame, key: str, of: str) -> DataFrame:
    """The keys that rows of two values of `of` or more have. Partial minima: a crowded key is small before the shuffle."""
    return keys.groupBy(key).agg(F.min(of).alias("a"), F.max(of).alias("z")).filter("a != z").select(key)


def _bit_map(met: DataFrame) -> bytes:
    """A bit for each key `k` (modulo the number of bits), packed in chunks by tasks; the driver gets the map alone."""
    bits = min(MOST_BITS, max(_CHUNK, 1 << (BITS_A_KEY * met.count() - 1).bit_length()))
    at = F.col("k").bitwiseAND(F.lit(bits - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low in batch.column("low"):
                on = np.zeros(_CHUNK, np.uint8)
                on[low.values.to_numpy()] = 1
                out.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.record_batch([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "bits"])

    rows = met.select(F.floor(at / _CHUNK).cast("int").alias("chunk"), (at % _CHUNK).cast("int").alias("low"))
    packed = rows.groupBy("chunk").agg(F.collect_set("low").alias("low")).mapInArrow(pack, "chunk int, bits binary")
    whole = bytearray(bits // 8)
    for row in packed.toLocalIterator():
        whole[row.chunk * _CHUNK // 8 : (row.chunk + 1) * _CHUNK // 8] = row.bits
    return bytes(whole)


def _marked_lines(docs: DataFrame, marks) -> DataFrame:
    """(d, t, p, h1, h2, line) of the lines with a half key that the broadcast bit map marks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, np.uint8)
        mask = np.uint64(8 * len(bits) - 1)
        for batch in _slices(batches):
            row, place, lines, keys, of = [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                for p, line in enumerate(text.split(b"\n")):
                    found = [k for kind, units in views(line) for k in half_keys(kind, units)]
                    if found:
                        of += [len(lines)] * len(found)
                        keys += found
                        row.append(i)
                        place.append(p)
                        lines.append(line)
            at = np.array(keys, np.uint64) & mask
            fine = np.zeros(len(lines), bool)
            fine[np.array(of, np.int64)[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]] = True
            kept = np.flatnonzero(fine)
            both = [xxhash.xxh3_128_intdigest(b" ".join(lines[i].split())) for i in kept]
            where = pa.array([row[i] for i in kept], pa.int64())
            columns = [
                batch.column("d").take(where), batch.column("t").take(where), pa.array([place[i] for i in kept], pa.int32()),
                pa.array([_signed(x >> 64) for x in both], pa.int64()), pa.array([_signed(x) for x in both], pa.int64()),
                pa.array([lines[i].decode() for i in kept], pa.string()),
            ]
            yield pa.record_batch(columns, names=["d", "t", "p", "h1", "h2", "line"])

    return _rows(docs).select("d", "t", "text").mapInArrow(split, "d long, t long, p int, h1 long, h2 long, line string")


def _neighbour_keys(lines: DataFrame) -> DataFrame:
    """(d, t, p, h1, key, at): the keys with a unit left out, at its place from 1, and of the whole line, at 0."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, keys, places = [], [], []
            for i, line in enumerate(texts(batch, "line")):
                for kind, units in views(line):
                    whole, less = neighbourhood(units)
                    if len(units) < (LEAST_CHARS if kind else WORDS):
                        less = []  # too short to be the longer one
                    found = np.array([whole, *less], np.uint64) ^ np.uint64(_MIX if kind else 0)
                    keys.append(found)
                    places.append(np.arange(len(found), dtype=np.int32))
                    where.append(np.full(len(found), i))
            if keys:
                row = pa.array(np.concatenate(where))
                yield pa.record_batch(
                    [batch.column(c).take(row) for c in ("d", "t", "p", "h1")] + [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places))],
                    names=["d", "t", "p", "h1", "key", "at"],
                )

    return lines.select("d", "t", "p", "h1", "line").mapInArrow(emit, "d long, t long, p int, h1 long, key long, at int")


def _first_partners(live: DataFrame) -> DataFrame:
    """(d, t, p, f): rows of shared keys with the earliest row that each key holds them against, where it is earlier."""
    place = F.struct("d", "t", "p")
    less, whole = live.filter("at > 0"), live.filter("at = 0")
    firsts = lambda rows, *by: rows.groupBy(*by).agg(F.min(place).alias("f"))
    replaced = less.join(firsts(less, "key", "at"), ["key", "at"])
    added = less.join(firsts(whole, "key"), "key")
    removed = whole.join(firsts(less, "key"), "key")
    pairs = [x.select("d", "t", "p", "f") for x in (replaced, added, removed)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).filter(F.col("f") < place).distinct()


def _verified(pairs: DataFrame) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [near_lines(a, b) for a, b in zip(texts(batch, "line"), texts(batch, "first_line"), strict=True)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return pairs.mapInArrow(check, pairs.schema)


def line_verdicts(docs: DataFrame) -> DataFrame:
    """(d, t, p, first): each line that goes, with the place of the earliest line that it repeats.

    Written tables are dropped once what reads them is written; the one behind the result stays.
    """
    spark = docs.sparkSession
    place = F.struct("d", "t", "p")
    lines = Table(spark, _lines(docs), "lines")
    halves = lines.df.select("h1", F.explode("ks").alias("k"))
    met = Table(spark, _met(halves, "k", "h1"), "met-halves")
    marks = spark.sparkContext.broadcast(_bit_map(met.df))  # MOST_BITS at most
    met.drop()
    marked = _marked_lines(docs, marks).groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "p")).alias("x"), F.min("line").alias("line"))
    wanted = Table(spark, marked.select("x.*", "h1", "h2", "line"), "candidate-lines")
    marks.unpersist()
    keys = _neighbour_keys(wanted.df)
    shared = Table(spark, _met(keys, "key", "h1"), "shared-keys")
    live = Table(spark, keys.join(shared.df, "key", "left_semi").select("d", "t", "p", "key", "at"), "live-keys")
    shared.drop()
    pairs = Table(spark, _first_partners(live.df), "line-pairs")
    live.drop()
    own = wanted.df.select("d", "t", "p", "h1", "h2", "line")
    other = wanted.df.select(F.struct("d", "t", "p").alias("f"), F.col("line").alias("first_line"))
    near = _verified(pairs.df.join(own, ["d", "t", "p"]).join(other, "f").select("h1", "h2", "d", "t", "p", F.col("f.d").alias("fd"), F.col("f.t").alias("ft"), F.col("f.p").alias("fp"), "line", "first_line"))
    near = near.groupBy("h1", "h2").agg(F.min(place).alias("own"), F.min(F.struct(F.col("fd").alias("d"), F.col("ft").alias("t"), F.col("fp").alias("p"))).alias("near"))
    repeated = lines.df.groupBy("h1", "h2").agg(F.min(place).alias("own_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = F.coalesce("own_first", "own")
    both = repeated.join(near, ["h1", "h2"], "full").select("h1", "h2", F.least(F.coalesce("near", first), first).alias("first"))
    verdict = Table(spark, both, "line-verdicts")
    wanted.drop()
    pairs.drop()
    every = lines.df.select("d", "t", "p", "h1", "h2").join(verdict.df, ["h1", "h2"])
    gone = Table(spark, every.filter(F.col("first") < place).select("d", "t", "p", "first"), "gone-lines")
    lines.drop()
    verdict.drop()
    return gone.df


def _gone(docs: DataFrame) -> DataFrame:
    """(d, t, dropped): the numbers of the lines that go, ascending."""
    return line_verdicts(docs).groupBy("d", "t").agg(F.array_sort(F.collect_set("p")).alias("dropped"))


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_dropped, dropped (line numbers from 0, ascending).

    Null text counts as empty. Lines end at \\n; those without words stay and are counted in n_lines only, an empty
    text has one. Lines are compared by their words. A null doc_id comes after all others; rows with one doc_id
    and one text share a verdict and so never drop each other's lines. An empty table gives an empty result; other
    columns are ignored.
    """
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    all_rows = _rows(docs).select("doc_id", "d", "t", n_lines.alias("n_lines"))
    none = F.array().cast("array<int>")
    return all_rows.join(_gone(docs), ["d", "t"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped")
    )


def without_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the dropped lines taken out of `text`; all columns stay, whatever their names; null text stays null.

    Repeated rows lose the same lines; an empty table gives an empty one.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, doc_id = F.coalesce(F.col("row.text"), F.lit("")), F.col("row.doc_id").cast("long")
    keyed = whole.select("row", F.coalesce(doc_id, F.lit(_LAST)).alias("d"), F.xxhash64(text, doc_id.isNull()).alias("t"))
    kept = F.array_join(F.filter(F.split(F.col("row.text"), "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    rest = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(kept)
    return keyed.join(_gone(docs), ["d", "t"], "left").select(F.col("row").withField("text", rest).alias("row")).select("row.*")
