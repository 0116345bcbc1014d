"""Repair of conversation structure by a time-major dynamic programme over tensors of conversations.

A repaired conversation is nothing, or pairs of user and assistant after at most one system turn. Rows are kept, given
another role, deleted, or preceded by empty turns; each edit has a cost, and of the cheapest edits those whose initials
are least in ASCII are taken. The programme has four states (nothing yet; after system; after user; after assistant).
Rows become one byte each; conversations are cut into lanes of at most LANE rows, lanes of equal length form a bucket,
and all lanes of a bucket go through each turn at once, from the last to the first for the costs, then forward for the
edits. Lanes of one long conversation are matrices of costs first, which are then multiplied up.

Rows are dealt by ranges of (conv_id, turn, role, text), so a conversation that holds a third of all rows is spread:
its rows become bytes where they lie, and only those bytes meet in one task, as its edits are one string anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._ranges import default_ranges, range_bucket, sortable, split_points
from tidewire.llm._store import kept, scratch, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_SPACE, _ENDS = b" \t\n\x0b\x0c\r", b".!?"
#: A row's byte: its role's initial (0 other, 1 s, 2 u, 3 a), and flags.
_INITIALS = {b"s": 1, b"u": 2, b"a": 3}
_MUST_GO, _TRUNCATED = 4, 8
#: State after a kept row, by initial and state; 4: not allowed. State and role after an inserted or reroled turn.
_KEPT = np.array([[4, 4, 4, 4], [1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4]])
_STEP, _ROLES = np.array([2, 2, 3, 2]), (b"user", b"user", b"assistant", b"user")
#: Cheapest way to an end from each state.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_FAR = np.int64(1 << 40)
#: Rows of a lane, and rows and bytes of the conversations that a task repairs at once.
LANE, _ROWS, _BYTES = 256, 50_000, 16 << 20
#: Bytes of a part of a repaired conversation on its way to its hash.
_PART = 4 << 20
_LEGAL = {b"su", b"ua", b"au"}
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (T + 1, N, 4) to finish from before each row and state: `codes` (T, N) are the rows' bytes, `end` (N, 4)
    the costs after the last one."""
    length, n = codes.shape
    out = np.empty((length + 1, n, 4), np.int64)
    out[length] = end
    later = np.empty((n, 5), np.int64)
    later[:, 4] = _FAR
    which = np.arange(n)[:, None]
    for t in range(length - 1, -1, -1):
        code = codes[t]
        later[:, :4] = out[t + 1]
        staying = np.where(code & _MUST_GO, _FAR, np.where(code & _TRUNCATED, TRUNCATED, 0))[:, None]
        best = np.minimum(DELETE + later[:, :4], np.minimum(staying + KEEP + later[which, _KEPT[code & 3]], staying + REROLE + later[:, _STEP]))
        for _ in range(2):  # no more than two turns are ever inserted at one place
            best = np.minimum(best, INSERT + best[:, _STEP])
        out[t] = best
    return out


def forward(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits (3 T, N), 0 where there is none: two places for inserted turns before each row, then the row's own;
    and the states (N,) after the last row. Of equal costs the edit of the least initial is taken."""
    length, n = codes.shape
    out, which, state = np.zeros((3 * length, n), np.uint8), np.arange(n), state.copy()
    for t in range(length):
        code, later = codes[t], costs[t + 1]
        stays = np.where(code & _MUST_GO, _FAR, np.where(code & _TRUNCATED, TRUNCATED, 0))
        for place in range(2):
            now = costs[t][which, state]
            put = (DELETE + later[which, state] != now) & (INSERT + costs[t][which, _STEP[state]] == now)
            out[3 * t + place][put] = ord("I")
            state = np.where(put, _STEP[state], state)
        now = costs[t][which, state]
        deleted = DELETE + later[which, state] == now
        after = _KEPT[code & 3, state]
        kept = ~deleted & (after < 4) & (stays + KEEP + later[which, np.minimum(after, 3)] == now)
        out[3 * t + 2] = np.where(deleted, ord("D"), np.where(kept, ord("K"), ord("R")))
        state = np.where(deleted, state, np.where(kept, after, _STEP[state]))
    return out, state


def _buckets(lanes: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    by_length: dict[int, list[int]] = {}
    for i, lane in enumerate(lanes):
        by_length.setdefault(len(lane), []).append(i)
    for length, own in by_length.items():
        yield own, np.frombuffer(b"".join(lanes[i] for i in own), np.uint8).reshape(len(own), length).T


def edits(conversations: list[bytes]) -> list[tuple[int, bytes, np.ndarray]]:
    """For each conversation, a byte a row: the cost, the edits' initials, and how many of them come before the end of
    each row (inserted ones stand before the row they precede, those at the end after the last)."""
    lanes, of = [], []
    for c in conversations:
        of.append(range(len(lanes), len(lanes) + max(1, -(-len(c) // LANE))))
        lanes += [c[i : i + LANE] for i in range(0, max(1, len(c)), LANE)]
    ends = np.tile(_END, (len(lanes), 1))
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
    inner = [i for r in of for i in r if len(r) > 1]
    table = np.empty((len(lanes) if inner else 0, 4, 4), np.int64)
    for own, codes in _buckets([lanes[i] for i in inner]):
        found = backward(np.repeat(codes, 4, 1), np.tile(unit, (len(own), 1)))[0]
        table[[inner[k] for k in own]] = found.reshape(len(own), 4, 4).transpose(0, 2, 1)  # [lane, from, to]
    for r in of:
        for i in reversed(r[:-1]):
            ends[i] = np.minimum(_FAR, (table[i + 1] + ends[i + 1]).min(1))
    traces: list = [None] * len(lanes)
    costs = np.zeros(len(lanes), np.int64)
    many = {i for r in of if len(r) > 1 for i in r}
    for own, codes in _buckets(lanes):
        back = backward(codes, ends[own])
        costs[own] = back[0][:, 0]
        single = [k for k, i in enumerate(own) if i not in many]
        if single:
            out, state = forward(codes[:, single], back[:, single], np.zeros(len(single), np.int64))
            for k, column, s in zip(single, out.T, state, strict=True):
                traces[own[k]] = {0: (column, s)}
        cut = [k for k, i in enumerate(own) if i in many]
        for start in range(4) if cut else ():
            out, state = forward(codes[:, cut], back[:, cut], np.full(len(cut), start))
            for k, column, s in zip(cut, out.T, state, strict=True):
                traces[own[k]] = (traces[own[k]] or {}) | {start: (column, s)}
    result = []
    for r in of:
        state, parts = 0, []
        for i in r:
            column, state = traces[i][int(state)]
            parts.append(column)
        column = np.concatenate(parts)
        upto = np.cumsum(column != 0)[2::3] if len(column) else np.zeros(0, np.int64)
        tail = b"I" * {0: 0, 1: 2, 2: 1, 3: 0}[int(state)]
        result.append((int(costs[r[0]]), column[column != 0].tobytes() + tail, upto))
    return result


@dataclass
class Rows:
    """Rows of one conversation, or of a stretch of it, read in order."""

    conv_id: int | None
    turns: list
    roles: list[bytes]
    texts: list[bytes]
    codes: bytearray
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0

    def add(self, turn, role: bytes, text: bytes, seen_before: bool) -> None:
        body = text.strip(_SPACE)
        code = _INITIALS.get(role[:1], 0)
        if not body:
            self.blank, code = self.blank + 1, code | _MUST_GO
        elif seen_before:
            self.duplicate, code = self.duplicate + 1, code | _MUST_GO
        elif body[-1] not in _ENDS:
            self.truncated, code = self.truncated + 1, code | _TRUNCATED
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.codes.append(code)

    def illegal(self) -> int:
        return sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(self.roles, self.roles[1:]))

    def gaps(self) -> tuple:
        """Smallest and largest turn, and how many there are."""
        own = {t for t in self.turns if t is not None}
        return (min(own), max(own), len(own)) if own else (None, None, 0)


def _turns(audit: bytes, roles: list[bytes], texts: list[bytes], state: int) -> tuple[list[bytes], int]:
    """The repaired turns of the rows that `audit` covers, as role:text, and the state after them."""
    out, at = [], 0
    for edit in audit:
        if edit == 73:  # I
            out.append(_ROLES[state] + b":")
            state = int(_STEP[state])
            continue
        role, text = roles[at], texts[at]
        at += 1
        if edit == 75:  # K
            state = int(_KEPT[_INITIALS[role[:1]], state])
        elif edit == 82:  # R
            role, state = _ROLES[state], int(_STEP[state])
        else:
            continue
        out.append(role + b":" + text)
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after damage: CRC-32 of `conv_id:turn`, mod 20, says what befalls a row.

    Null role and text are one space, as is a null conv_id or turn in the hash. Dropped rows stay as empty ones with
    `gone`, so that their conversations are known. Rows with a null conv_id are one conversation.
    """
    space = F.lit(" ")
    number = F.concat(*[F.coalesce(F.col(c).cast("long").cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind = F.crc32(number.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_ORDER = ("conv_id", "turn", "role", "text")


def _key() -> Column:
    """Bytes in the order of the rows, null turns first; of role and text the first 8 and 24 bytes' hex digits."""
    turn = F.when(F.col("turn").isNull(), "").otherwise(sortable(F.col("turn")))
    start = [F.hex(F.substring(F.col(c).cast("binary"), 1, n)) for c, n in (("role", 8), ("text", 24))]
    return F.concat(sortable(F.col("conv_id")), F.lit("-"), F.rpad(turn, 16, "-"), F.rpad(start[0], 16, "-"), start[1])


def _read(batches: Iterator[pa.RecordBatch], seen_columns: bool = False) -> Iterator[tuple[tuple, Rows]]:
    """Stretches of rows that share a conversation (and a range, of cut ones), from rows in order. A row is seen before
    if an equal one came earlier in the stretch or, of cut conversations, in an earlier turn."""
    now, own, seen = None, None, set()
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("range", "conv_id", "turn", "gone")]
        cols += [batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text")]
        firsts = zip(batch.column("repeated").to_pylist(), batch.column("first_turn").to_pylist(), strict=True) if seen_columns else ((False, None) for _ in range(batch.num_rows))
        for where, conv, turn, gone, role, text, (repeated, first) in zip(*cols, firsts, strict=True):
            key = (where, conv) if seen_columns else (conv,)
            if key != now:
                if own is not None:
                    yield now, own
                now, own, seen = key, Rows(conv, [], [], [], bytearray()), set()
            if gone:
                continue
            digest = hashlib.blake2b(role + b"\0" + text, digest_size=16).digest() if len(text) > 64 else (role, text)
            if not seen_columns:
                before = digest in seen
                seen.add(digest)
            else:  # equal rows of one turn are neighbours
                before = repeated and (turn != first or digest in seen)
                seen = {digest}
            own.add(turn, role, text, before)
    if own is not None:
        yield now, own


def _result(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int64() if i < 7 else pa.string()) for i in range(9)], names=names)


def _gap(low, high, n) -> int:
    return high - low + 1 - n if n else 0


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n_rows, n_bytes = [], 0, 0
    for _, own in _read(batches):
        held.append(own)
        n_rows, n_bytes = n_rows + len(own.codes), n_bytes + sum(map(len, own.texts))
        if n_rows >= _ROWS or n_bytes >= _BYTES or len(held) >= _ROWS:
            yield _repaired(held)
            held, n_rows, n_bytes = [], 0, 0
    yield _repaired(held)


def _repaired(held: list[Rows]) -> pa.RecordBatch:
    out = []
    for own, (cost, audit, _) in zip(held, edits([bytes(o.codes) for o in held]), strict=True):
        turns, _ = _turns(audit, own.roles, own.texts, 0)
        out.append((own.conv_id, _gap(*own.gaps()), own.blank, own.duplicate, own.truncated, own.illegal(), cost, audit.decode(), hashlib.sha256(b"\n".join(turns)).hexdigest()))
    return _result(out)


_STRETCH = "range int, conv_id long, codes binary, low long, high long, n long, blank long, duplicate long, truncated long, illegal long, first binary, last binary"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (where, conv), own in _read(batches, True):
        ends = (own.roles[0][:1], own.roles[-1][:1]) if own.roles else (None, None)
        row = (where, conv, bytes(own.codes), *own.gaps(), own.blank, own.duplicate, own.truncated, own.illegal(), *ends)
        types = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 7, pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _STRETCH.split(", ")])


_PLAN = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, range int, part binary, state int, low long, high long, n long"


def _plan_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of cut conversations: a row with the whole for each (range null), and one for each of its stretches."""
    types = [*[pa.int64()] * 6, pa.string(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 3]
    for batch in batches:
        for conv, own in zip(batch.column("conv_id").to_pylist(), batch.column("own").to_pylist(), strict=True):
            own.sort(key=lambda s: s["range"])
            cost, audit, upto = edits([b"".join(s["codes"] for s in own)])[0]
            ends = [s for s in own if s["codes"]]
            illegal = sum(s["illegal"] for s in own) + sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(ends, ends[1:]))
            lows, highs = [s["low"] for s in own if s["n"]], [s["high"] for s in own if s["n"]]
            total = [sum(s[k] for s in own) for k in ("blank", "duplicate", "truncated")]
            rows = [(conv, *total, illegal, cost, audit.decode(), None, None, None, min(lows, default=None), max(highs, default=None), None)]
            at, row, state = 0, 0, 0
            for s in own:
                row += len(s["codes"])
                to = len(audit) if s is own[-1] else int(upto[row - 1]) if row else 0
                rows.append((conv, None, None, None, None, None, None, s["range"], audit[at:to], state, None, None, None))
                for edit, code in _with_codes(audit[at:to], s["codes"]):
                    state = int(_STEP[state]) if edit in b"IR" else int(_KEPT[code & 3, state]) if edit == 75 else state
                at = to
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in _PLAN.split(", ")])


def _with_codes(audit: bytes, codes: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    for edit in audit:
        yield edit, codes[at] if edit != 73 else 0
        at += edit != 73


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired stretches of cut conversations, in parts of some MB. A stretch's edits come as a row before its own."""
    where, audit, at, state, n, held, size = (0, 0), b"", 0, 0, 0, [], 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("range", "conv_id", "head", "state", "part")]
        cols += [batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text")]
        out: list[tuple] = []

        def close() -> None:
            nonlocal n, held, size
            if held:
                n += 1
                out.append((where[1], where[0], n, b"\n".join(held)))
            held, size = [], 0

        for to, conv, head, start, part, role, text in zip(*cols, strict=True):
            if head == 0:
                close()
                where, audit, at, state = (to, conv), part, 0, start
                continue
            end = at
            while audit[end] == 73:
                end += 1
            end += 1
            if len(audit) - end <= 2 and not audit[end:].strip(b"I"):  # those inserted after the last row
                end = len(audit)
            turns, state = _turns(audit[at:end], [role], [text], state)
            at = end
            held += turns
            size += sum(map(len, turns))
            if size >= _PART:
                close()
        close()
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["conv_id", "range", "n", "bytes"])


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's parts, read one after another."""
    names, now, digest = ["conv_id", "repaired_sha256"], (), None
    for batch in batches:
        out = []
        for conv, data in zip(batch.column("conv_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if now != (conv,):
                if digest is not None:
                    out.append((now[0], digest.hexdigest()))
                now, digest = (conv,), hashlib.sha256(data)
            else:
                digest.update(b"\n" + data)
        yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=names)
    if digest is not None:
        yield pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=names)


def _repair_cut(rows: DataFrame) -> DataFrame:
    """Results of the conversations that lie in more than one range."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    mark = F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")), 256).alias("digest")
    rows = written(rows.withColumn("digest", mark), "cut")
    firsts = rows.filter("not gone").groupBy("conv_id", "digest").agg(F.min(turn).alias("least"), F.count("*").alias("times")).filter("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.when(F.col("least.known"), F.col("least.turn")).alias("first_turn"), F.lit(True).alias("repeated"))
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("range", *_ORDER, "gone", "first_turn", F.coalesce("repeated", F.lit(False)).alias("repeated"))
    rows = written(rows, "flagged")
    in_order = rows.repartition("range").sortWithinPartitions("range", *_ORDER)
    stretches = written(in_order.mapInArrow(_stretches, _STRETCH), "stretches")
    known = rows.filter("turn is not null and not gone").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("distinct"))
    whole = stretches.groupBy("conv_id").agg(F.collect_list(F.struct(*[c for c in stretches.columns if c != "conv_id"])).alias("own"))
    plan = written(whole.mapInArrow(_plan_long, _PLAN), "plan")
    heads = plan.filter("range is not null and length(part) > 0").select("range", "conv_id", F.lit(0).alias("head"), "state", "part", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))])
    texts = rows.filter("not gone").select("range", "conv_id", F.lit(1).alias("head"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("binary").alias("part"), "turn", "role", "text")
    texts = heads.unionByName(texts).repartition("range").sortWithinPartitions("range", "conv_id", "head", "turn", "role", "text")
    parts = texts.mapInArrow(_parts, "conv_id long, range int, n long, bytes binary")
    hashes = parts.repartition("conv_id").sortWithinPartitions("conv_id", "range", "n").mapInArrow(_hash_parts, "conv_id long, repaired_sha256 string")
    out = plan.filter("range is null").drop("range", "part", "state", "n")
    hashes, known = hashes.withColumnRenamed("conv_id", "h"), known.withColumnRenamed("conv_id", "k")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left").join(known, F.col("conv_id").eqNullSafe(F.col("k")), "left")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    return out.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """One row a conversation of `rows` (conv_id, turn, role, text, gone), null conv_ids being one: gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Order is by turn, null first, then role, then text (bytes), so repeated rows are neighbours. A role without an
    initial (empty) is kept nowhere. An empty table gives an empty one; other columns are ignored.
    """
    with scratch() as made:
        n_ranges = n_ranges or default_ranges(rows.sparkSession)
        rows = rows.select(*_ORDER, "gone")
        key = _key()
        splitters = split_points(rows, key, n_ranges)
        conv = sortable(F.col("conv_id"))
        cut = range_bucket(F.concat(conv, F.lit("-")), splitters) != range_bucket(F.concat(conv, F.lit("z")), splitters)
        dealt = rows.select(range_bucket(key, splitters).alias("range"), cut.alias("cut"), *_ORDER, "gone")
        whole = dealt.filter("not cut").repartition("range").sortWithinPartitions("range", *_ORDER)
        out = whole.mapInArrow(_repair_whole, _RESULT).unionByName(_repair_cut(dealt.filter("cut")))
        return kept(out, "repaired", made)


def repair_damaged(conversations: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """repair() of the damaged rows. See there for nulls, ties, repeated rows and empty tables."""
    return repair(damaged(conversations), n_ranges)
