"""The llm operators against plain versions on small tables with nulls, empty texts, ties and repeated rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidewire.llm import exact_dedup, html_text, licenses, line_dedup, mixing, packing, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, p int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(120):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        out.append((i, text, r.choice(["en", None]), r.choice(["a", "b", None]), len(text), "x", 1))
    out += [(200 + i, out[3][1] + "  ", "en", "a", 5, "x", 1) for i in range(30)]  # a hot group
    out += [(300, None, None, None, None, None, None), (301, "", "en", "a", 0, "x", 1), (302, "word " * 5000, "en", "b", 25000, "x", 1), out[5], out[5]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows):
    norm = {}
    for d, t, *_ in rows:
        norm.setdefault(" ".join([""] * (t or "").startswith(" ") + (t or "").split() + [""] * (t or "").endswith(" ")), []).append(d)
    want = sorted((d, min(v), len(v)) for v in norm.values() for d in v)
    got = exact_dedup.exact_groups(docs, n_ranges=50).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(norm)
    assert exact_dedup.drop_exact_copies(docs).count() == len(norm)


def test_near_duplicates(docs, rows):
    marks = {(d, t): simhash.fingerprint((t or "").encode()) for d, t, *_ in rows}
    parent = {k: k for k in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(marks, 2):
        if bin(marks[a] ^ marks[b]).count("1") <= 4:
            parent[find(a)] = find(b)
    least = {}
    for k in marks:
        least[find(k)] = min(least.get(find(k), 10**9), k[0])
    want = sorted((r[0], f"{marks[r[:2]]:016x}", least[find(r[:2])]) for r in rows)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_packing(docs, rows):
    tokenizer = packing.ChunkTokenizer(packing.default_path())._tokenizer
    got = packing.best_fit(docs.dropDuplicates(["doc_id"])).toPandas()
    assert packing.best_fit(docs, task_pieces=40).count() == len(got) + 2  # two rows are repeated
    for d, t, *_ in {r[0]: r for r in rows}.values():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = got[got.doc_id == d].sort_values("piece")
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert own.length.tolist() == [len(c) for c in cut]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048


def test_mixing(docs):
    got = mixing.fair_mix(docs).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= got["size"].max()
    assert mixing.mixed_documents(docs).count() == int((got.taken / got["size"].clip(lower=1)).sum())


def test_sharding(docs):
    got = sharding.curve_shards(docs).toPandas()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    points = [np.array(x) for x in zip(*itertools.product(range(4), repeat=3), strict=True)]
    at = sharding.hilbert_index(points, 2)
    order = np.stack(points, 1)[np.argsort(at)]
    assert sorted(at) == list(range(64)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_licenses():
    finder = licenses.NoticeFinder()
    labels = {x[2] for x in finder.find(b" released under the mti license today gnu generall public license ")}
    assert labels == {"mit", "gpl"}
    assert licenses.exact_places(b" cc by nc cc by nc ") == [(0, "cc-by-nc"), (3, "cc-by-nc")]


def test_toxicity():
    r = random.Random(3)
    text = lambda bad: " ".join([r.choice("alpha beta gamma delta".split()) for _ in range(40)] + ["scumword", "vileword"][: 1 + r.randint(0, 1)] * bad).encode()
    flags = np.array([i % 4 == 0 for i in range(200)], int)
    model = toxicity.fit([np.fromiter(sorted(toxicity.features(text(t))), np.uint32) for t in flags], flags)
    assert all(model.grades(text(1))[0] < 0.5 and model.grades(text(0))[0] > 0.5 for _ in range(50))


def test_line_dedup(spark):
    a = "one two three four five six seven eight nine"
    near = [(1, a + "\nshort"), (2, a.replace("five", "5") + "\nshort"), (3, "zero " + a), (4, a.replace("one", "x").replace("nine", "y")), (5, None)]
    got = {r.doc_id: r.dropped for r in line_dedup.deduplicate_lines(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 1], 3: [0], 4: [], 5: []}


def test_html():
    assert html_text.page_text("<ul><li>a<li>b</ul><p hidden>x<p>c<table><tr><td>n<td>1<tr><td>long<td>2</table>") == "- a\n- b\n\nc\n\nn     1\nlong  2"
    assert html_text.page_text("") == "" and html_text.page_text("<div>" * 5000 + "x") == "x"


def test_empty_tables(none):
    for f in (exact_dedup.exact_groups, simhash.near_duplicates, packing.best_fit, mixing.fair_mix, sharding.curve_shards, licenses.license_report, line_dedup.deduplicate_lines):
        assert f(none).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns
        docs = after


CLASHING = "doc_id long, text string, source string, lang string, n_chars long, p int, rn int, starts string, `_id` int, `_n` int, `_size` int, others int, raw int, `a.b` int, row int"


def test_exact_stage_keeps_columns_and_one_row_a_group(spark):
    r = random.Random(2)
    texts = ["x" * 70 + str(i % 5) for i in range(60)] + ["a  b", "a b", "a\tb", " a b", None, "", "hot text"] + ["hot text"] * 200
    rows = [(r.choice([None, *range(40)]), t, "s", "en", 1, r.randrange(3), 2, "z", 4, 5, 6, 7, 8, 9, 10) for t in texts]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, CLASHING)
    best = {}
    for row in rows:
        norm = "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in row[1] or "")
        while "  " in norm:
            norm = norm.replace("  ", " ")
        key = (row[0] is None, row[0] or 0, row[1] is None, row[5])
        if norm not in best or key < best[norm][0]:
            best[norm] = (key, {row[1]} if norm in best else {row[1]})
        if key == best[norm][0]:
            best[norm][1].add(row[1])
    for n_ranges in (1, 7, 60):
        got = exact_dedup.drop_exact_copies(docs, n_ranges=n_ranges)
        assert got.columns == docs.columns
        found = got.collect()
        assert len(found) == len(best)
        for row in found:
            norm = exact_dedup.normalised  # noqa: F841
            key = (row.doc_id is None, row.doc_id or 0, row.text is None, row.p)
            assert any(key == k and row.text in t for k, t in best.values()) and row["_n"] == 5 and row["a.b"] == 9
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_shards_are_even_and_hold_every_row(spark, docs, rows, tmp_path):
    got = sharding.curve_shards(docs).toPandas()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    assert set(got.law) == {"bytes"} and got.shard.between(0, 15).all() and got.grown_shard.isna().all()
    docs01 = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    whole = sharding.curve_shards(docs01).toPandas()
    sums = whole.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() < 1.1 * sums.mean() and sums.min() > 0.9 * sums.mean()
    groups = whole[whole["size"] > 30].groupby("text_crc32").agg(n=("shard", "nunique"), total=("size", "sum"))
    assert (groups.n[groups.total < sharding.WHOLE_GROUP * sums.mean() / 1.1] == 1).all()
    sharding.write_shards(docs, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.count() == len(rows) and set(docs.columns) | {"shard"} == set(back.columns)
    clash = docs.selectExpr("*", "1 shard", "2 slot", "3 _crc")
    sharding.write_shards(clash, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).select("row.*").columns == clash.columns
