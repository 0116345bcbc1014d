"""Line deduplication against a plain comparison of all lines."""

import random

import pytest

from tidewire.llm import line_dedup

SCHEMA = "doc_id long, text string, d int, t string, dropped int, row string"


def edit(a, b):
    """Levenshtein distance of two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    x, y = a.split(), b.split()
    if max(len(x), len(y)) >= 8 and abs(len(x) - len(y)) < 2 and edit(x, y) <= 1:
        return True
    x, y = " ".join(x), " ".join(y)
    return max(len(a.split()), len(b.split())) < 8 and max(len(x), len(y)) >= 20 and abs(len(x) - len(y)) < 2 and edit(x, y) <= 1


def plain(rows):
    """Dropped line numbers by row: a line goes if a line of an earlier place equals it or is near it."""
    keyed = {}
    for d, t, *_ in rows:
        keyed[(d is None, d or 0, t or "")] = None
    lines = {}  # normalised line -> earliest place
    order = sorted(keyed, key=lambda k: (k[0], k[1], line_hash.get(k, 0)))
    places = [(rank, p, " ".join(line.split())) for rank, k in enumerate(order) for p, line in enumerate(k[2].split("\n")) if line.split()]
    for rank, p, line in places:
        lines.setdefault(line, (rank, p))
    gone = {}
    for line, own in lines.items():
        gone[line] = min([own, *[at for other, at in lines.items() if at < own and near(line, other)]])
    out = {}
    for rank, p, line in places:
        if gone[line] < (rank, p):
            out.setdefault(order[rank], []).append(p)
    return out


line_hash: dict = {}


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    line_hash.clear()
    for r in line_dedup._rows(docs).collect():
        line_hash[(r.doc_id is None, r.doc_id or 0, r.text)] = r.t
    want = plain(rows)
    got = line_dedup.deduplicate_lines(docs).collect()
    expected = sorted((repr(d), len((t or "").split("\n")), want.get((d is None, d or 0, t or ""), [])) for d, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.n_lines, r.dropped) for r in got) == expected
    assert all(r.n_dropped == len(r.dropped) for r in got)
    return want


def test_random_lines_equal_all_pairs(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (5, 6, 7, 7, 8, 8, 9, 12, 12, 40) for _ in range(2)]
    hot = "a template line of many words with one filling here"

    def changed(line):
        w = line.split()
        for _ in range(r.choice([0, 1, 1, 2])):
            k, at = r.random(), r.randrange(len(w))
            if k < 0.4:
                w[at] = r.choice(words)
            elif k < 0.7:
                w.insert(at, r.choice(words))
            elif len(w) > 1:
                del w[at]
        text = list(" ".join(w))
        if r.random() < 0.4:
            text[r.randrange(len(text))] = r.choice("xyz ")
        return "".join(text)

    rows = []
    for i in range(60):
        lines = [changed(r.choice(base)) for _ in range(r.randint(0, 6))] + [hot.replace("filling", f"f{r.randrange(20)}")] * (i % 3 == 0) + ["  "] * (i % 5 == 0)
        rows.append((i, "\n".join(lines), 1, "x", 2, "y"))
    rows += [rows[7], rows[7], (7, "other text\n" + base[0], 1, "x", 2, "y"), (None, base[3], 1, "x", 2, "y"), (1000, None, 1, "x", 2, "y"), (1001, "", 1, "x", 2, "y")]
    rows += [((1 << 63) - 1, base[4] + "\n" + base[4], 1, "x", 2, "y"), (1002, "long " * 900 + "\n" + "long " * 900 + "x", 1, "x", 2, "y")]
    want = check(spark, rows)
    assert sum(map(len, want.values())) > 60
    docs = spark.createDataFrame(rows, SCHEMA)
    left = line_dedup.without_lines(docs)
    assert left.columns == docs.columns
    stays = lambda d, t: t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get((d is None, d or 0, t), []))
    assert sorted((repr(x.doc_id), repr(x.text)) for x in left.collect()) == sorted((repr(d), repr(stays(d, t))) for d, t, *_ in rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "1 d", "'x' t", "2 dropped", "'y' row")
    rows = [tuple(r) for r in docs.collect()]
    assert sum(map(len, check(spark, rows).values())) > 100


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.deduplicate_lines(empty).count() == 0 == line_dedup.without_lines(empty).count()


@pytest.mark.parametrize(("a", "b", "want"), [("a b c d e f g h", "a b c d e f g", True), ("a b c d e f g", "a b c d e f", False), ("twenty characters line", "twenty charakters line", True), ("short line", "short lime", False)])
def test_near_lines(a, b, want):
    assert line_dedup.near_lines(a.encode(), b.encode()) is want is line_dedup.near_lines(b.encode(), a.encode()) is near(a, b)
