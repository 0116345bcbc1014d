"""Packing of tokenised documents into sequences by bounded-space online best-fit.

A fixed number of bins stays open, in a bitset keyed by free space: a piece goes to the fullest bin that still takes
it, found by one shift of the bitset; when another bin would be one too many, the fullest of all closes. Only
documents longer than a sequence are cut. Packing tasks take about PIECES_A_TASK pieces each, dealt by a hash of their
row numbers, and pack them as they come: a task holds its open bins and one batch, never its group.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._store import written
from tidewire.llm._texts import texts

SEQUENCE, OPEN_BINS, END = 2048, 4096, 0
#: About so many pieces are packed by a task.
PIECES_A_TASK = 60_000
TOKENIZER = "word_bpe_49k.json"
_CACHED = 400_000
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SEEN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
#: The model's letter for each byte of UTF-8: itself if it can be seen, else one from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_SEEN)))}


class _Cache(dict):
    """Values that `of` makes, at most _CACHED at a time."""

    def __init__(self, of: Callable):
        super().__init__()
        self._of = of

    def __missing__(self, key):
        value = self._of(key)
        if len(self) >= _CACHED:
            self.clear()
        self[key] = value
        return value


class ChunkTokenizer:
    """Ids of texts, as little-endian 32-bit bytes, with a cache of what stands between white space.

    The tokenizer never merges over white space, so a text's ids are those of its chunks one after another. Chunks
    of printable ASCII without `<` and letters of Latin-1 go straight to the BPE model; all others pass the whole
    tokenizer. A-Z are lower-cased first where that changes no id: the tokenizer does so itself, but after it has joined
    letters with combining marks (U+0300 to U+036F) and found its special tokens (`<|`).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._known, self._pieces = self._tokenizer.model, _Cache(self._chunk), _Cache(self._piece)

    def ids(self, text: bytes) -> bytes:
        if not (b"\xcc" in text or b"\xcd" in text or b"<|" in text):
            text = text.lower()
        return b"".join(map(self._known.__getitem__, text.split()))

    def _chunk(self, chunk: bytes) -> bytes:
        text, pieces = chunk.decode(), self._pieces
        word = text.rstrip(".,")
        if _LETTERS.fullmatch(word):
            ids = pieces[word.lower()]
            return ids if len(word) == len(text) else ids + pieces[text[len(word) :]]
        if not _PLAIN.fullmatch(text):
            return pack_ids(self._tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join([pieces[piece] for piece in _PIECE.findall(text.lower())])

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return pack_ids([t.id for t in self._model.tokenize(shown)])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer a worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut where longer than a sequence.

    Null and empty texts are one piece of the end id alone. A null doc_id is carried along.
    """
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end = tokenizer(path), END.to_bytes(4, "little")
        for batch in batches:
            doc_ids, out = batch.column("doc_id").to_pylist(), [[], [], [], [], []]
            for doc_id, text in zip(doc_ids, texts(batch), strict=True):
                data = memoryview(of.ids(text) + end)
                for piece, at in enumerate(range(0, len(data), 4 * sequence)):
                    part = data[at : at + 4 * sequence]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Best-fit with a bounded number of open bins."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.open, self.made = capacity, most, 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        same = self.bins[free]
        number = same.pop()
        if not same:
            del self.bins[free]
            self.bits ^= 1 << free
        self.open -= 1
        return number


_PLACED = _PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


def best_fit(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, task_pieces: int = PIECES_A_TASK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece stands.

    Pieces are packed in the order of their rows. Repeated rows are packed each by itself and spread over tasks like
    others. Null and empty texts are one piece of one id. An empty table gives an empty result; columns other than
    doc_id and text are ignored. A lost executor's pieces are tokenised again, and packed again in the same order;
    sequence numbers hold the task's.
    """
    pieces = written(token_pieces(docs, path, sequence).withColumn("row", F.monotonically_increasing_id()), "pieces")
    tasks = max(1, -(-pieces.count() // task_pieces))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(sequence, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.record_batch(
                [*[batch.column(f.name) for f in _PIECES], pa.array([base + s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())], schema=_PLACED
            )

    dealt = pieces.repartition(tasks, F.xxhash64("row")).sortWithinPartitions("row")
    return dealt.mapInArrow(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
