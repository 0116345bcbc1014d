"""The prefix trie against a plain one, on hand-made and on the smallest given conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidewire.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes, by walking every rebuilt conversation."""
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def result(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(NAMES).collect())


def made():
    r = random.Random(5)
    rows = []
    for c in range(90):
        for t in range(r.randint(0, 5)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "a b\td "]), 1, "x"))
    for c in range(100, 190):  # copies, longer than most, and their like with another end
        rows += [(c, t, "user", f"same {t % 3}", 1, "x") for t in range(12)] + [(c, 12, "user", "end" if c < 180 else f"end {c % 4}", 1, "x")]
    rows += [(200, t, "user", f"long {t}", 1, "x") for t in range(3000)]
    rows += [(301, None, None, None, None, None), (301, 1, "user", "", 1, "x"), (301, None, "user", "x", 1, "x"), (302, 1, "user", "x", 1, "x"), (302, 1, "user", "x", 1, "x"), (None, 1, "user", "x", 1, "x")]
    rows += [(300, None, "b", "y z", 1, "x"), (300, None, "a", "y", 1, "x"), (300, 0, "a", "y", 1, "x")]
    r.shuffle(rows)
    return rows


def test_made_conversations(spark):
    rows = made()
    assert result(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_many_members_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "HEAVY", 3)
    rows = made()[:600]
    assert result(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
    assert result(queries.queries()["op11_prefix_trie"](spark, f"/root/testdata/{sf}")) == plain(rows)


def test_no_conversations(spark):
    df = prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert df.columns == NAMES and df.count() == 0
    assert result(prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "x")], SCHEMA))) == []
    assert len(result(prefix_trie.prefix_trie(spark.createDataFrame([(21, 1, "user", "x", 1, "x")], SCHEMA)))) == 2 - (zlib.crc32(b"21") % 4 > 0)


def test_given_conversations_as_by_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = db.execute(f"SELECT {', '.join(NAMES)} FROM ({queries.oracle_sql()['op11_prefix_trie']})").fetchall()
    assert result(queries.op11_prefix_trie(spark, "/root/testdata/sf0.001")) == sorted(tuple(-1 if x is None else x for x in r) for r in want)
