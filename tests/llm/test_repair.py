"""Repairs against a plain search over all edits, and against a plain dynamic programme on the given conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tidewire.llm import queries, repair

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, gone int, range string"
FINE = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, turns) by trying everything, with rows (role, text, must_go, truncated)."""

    @lru_cache(None)
    def best(i, shape):  # shape: e empty, s, u, a
        ways = []
        follow = {"e": "su", "s": "u", "u": "a", "a": "u"}[shape]
        names = {"u": "user", "a": "assistant"}
        if i == len(rows):
            if shape in "ea":
                ways.append((0, "", ()))
            else:
                for x in follow:
                    c, a, t = best(i, x)
                    ways.append((c + 3, "I" + a, ((names[x], ""), *t)))
            return min(ways)
        role, text, must, cut = rows[i]
        c, a, t = best(i + 1, shape)
        ways.append((c + 4, "D" + a, t))
        if not must:
            if role[:1] and role[:1] in follow:
                c, a, t = best(i + 1, role[0])
                ways.append((c + 3 * cut, "K" + a, ((role, text), *t)))
            for x in set(follow) & set("ua"):
                c, a, t = best(i + 1, x)
                ways.append((c + 3 + 3 * cut, "R" + a, ((names[x], text), *t)))
        for x in set(follow) & set("ua"):  # at most two insertions at one place are worth it
            for n in (1, 2):
                state, put = shape, []
                for _ in range(n):
                    state = {"e": "u", "s": "u", "u": "a", "a": "u"}[state]
                    put.append((names[state], ""))
                c, a, t = once(i, state)
                ways.append((c + 3 * n, "I" * n + a, (*put, *t)))
        return min(ways, key=lambda w: w[:2])

    @lru_cache(None)
    def once(i, shape):
        """As best(), without insertions before row i."""
        role, text, must, cut = rows[i]
        follow = {"e": "su", "s": "u", "u": "a", "a": "u"}[shape]
        names = {"u": "user", "a": "assistant"}
        c, a, t = best(i + 1, shape)
        ways = [(c + 4, "D" + a, t)]
        if not must:
            if role[:1] and role[:1] in follow:
                c, a, t = best(i + 1, role[0])
                ways.append((c + 3 * cut, "K" + a, ((role, text), *t)))
            for x in set(follow) & set("ua"):
                c, a, t = best(i + 1, x)
                ways.append((c + 3 + 3 * cut, "R" + a, ((names[x], text), *t)))
        return min(ways, key=lambda w: w[:2])

    return best(0, "e")


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own[c] += []
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own[c] += [(t is not None, t or 0, ("user" if kind == 4 else role).encode(), text.encode())] * (1 + (kind == 3))
    out = []
    for c, v in own.items():
        v.sort()
        seen, count, marked = set(), [0, 0, 0], []
        for *_, role, text in v:
            body = text.strip(b" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1:] not in (b".", b"!", b"?") else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            marked.append((role.decode(), text, fault in (0, 1), fault == 2))
        cost, audit, turns = cheapest(tuple(marked))
        assert FINE.fullmatch("".join(r[0] for r, _ in turns))
        turns = b"\n".join(r.encode() + b":" + (t or b"") for r, t in ((r, t or b"") for r, t in turns))
        known = [t for k, t, *_ in v if k]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in (b"su", b"ua", b"au") for a, b in itertools.pairwise(v))
        out.append((c, gaps, *count, illegal, cost, audit, hashlib.sha256(turns).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=str)


def made():
    r = random.Random(3)
    rows = []
    for c in range(400):
        for t in range(r.randint(1, 9)):
            text = r.choice(["Yes.", "No!", "so", " ", "What? ", "é.", "Yes.", "a b c.\n", "x" * 70 + "."])
            rows.append((r.choice([c, c, c, None]) if c % 90 == 0 else c, r.choice([t, t, t, None, 3 * t]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), text, 1, "x"))
    for t in range(700):  # a long one
        rows.append((1000, t, r.choice(["user", "assistant", "system", "tool"]), r.choice([f"Line {t}.", f"cut {t}", "Same.", ""]), 1, "x"))
    rows += [(1001, 5, "user", "Copy.", 1, "x")] * 40 + [(1002, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("n_ranges", [4, 300])
def test_made_conversations(spark, n_ranges):
    rows = made()
    assert result(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(3), n_ranges)) == plain(rows)


def test_lanes_of_long_conversations(monkeypatch):
    r = random.Random(9)
    codes = [bytes(r.choice([0, 1, 2, 3, 2, 3, 4, 6, 10, 11, 9]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    whole = [x[:2] for x in repair.edits(codes)]
    for lane in (1, 2, 7):
        monkeypatch.setattr(repair, "LANE", lane)
        assert [x[:2] for x in repair.edits(codes)] == whole


def test_cheapest_edits_of_all_short_conversations():
    initial = {"s": 1, "u": 2, "a": 3, "t": 0}
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    kinds = [(x, m) for x in initial for m in (0, 4, 8)]
    shapes = [s for n in range(4) for s in itertools.product(kinds, repeat=n)]
    got = repair.edits([bytes(initial[x] | m for x, m in s) for s in shapes])
    for shape, (cost, audit, _) in zip(shapes, got, strict=True):
        assert (cost, audit.decode()) == cheapest(tuple((names[x], b"", m == 4, m == 8) for x, m in shape))[:2]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
    assert result(queries.queries()["op13_repair"](spark, f"/root/testdata/{sf}")) == plain(rows)


def test_no_conversations(spark):
    df = repair.repair_damaged(spark.createDataFrame([], SCHEMA))
    assert df.columns == NAMES and df.count() == 0
