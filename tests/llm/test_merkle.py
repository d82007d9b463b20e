import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import merkle as M

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, t, lang, source, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))


def climb(nodes):
    """Root and, for each node, its (left, right) siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for x, pos in enumerate(at):
            first = pos - pos % 8
            paths[x].append(("".join(nodes[first:pos]), "".join(nodes[pos + 1 : first + 8])))
            at[x] = pos // 8
        nodes = [H("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for lang in langs}
    trees = {lang: climb([leaf(*r) for r in members[lang]]) for lang in langs}
    root, above = climb([trees[lang][0] for lang in langs])
    out = []
    for lang, over in zip(langs, above):
        for r, path in zip(members[lang], trees[lang][1]):
            i, t = r[:2]
            fold = leaf(*r)
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None:
                fold = leaf(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t), *r[2:])
            for left, right in path + over:
                fold = H(left, fold, right)
            out.append((i, leaf(*r), trees[lang][0], root, H(*(left + right for left, right in path + over)), fold, fold == root))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, "Upper É ß", None, "web", 9),
    (None, "No Id", "en", "a", 5),
    (None, "No Id", "en", "a", 5),
    (None, "other", "", "a", 5),
    (4, "Same", "de", "a", 4),
    (4, "Same", "de", "a", 4),
    (4, "Not the same", "de", "a", 4),
    (5, "日本\U0001f600 A\nB", "é", "", -7),
    (6, "Long text " * 200_000, "e", "b", 1),
    (-12, "minus", "e", "b", 1),
]


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of one level, so that a few hundred rows need several tiers."""
    monkeypatch.setattr(M, "DEPTH", 1)
    monkeypatch.setattr(M, "BLOCK", M.FANOUT)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in ODD], DOC + ", key string, pos int, leaf long")
    assert got(M.manifest(docs)) == brute(ODD)


def test_several_tiers(spark, small_blocks):
    rows = [(i, f"Text {i}" if i % 5 else f"text {i}", ["en", "de", None][min(i % 7, 2)], "s", i) for i in range(700)] + ODD[:10]
    docs = spark.createDataFrame(rows, DOC).repartition(7)
    assert got(M.manifest(docs)) == brute(rows)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65])
def test_sizes_around_a_run(spark, n, small_blocks):
    rows = [(i, "T", "en", "s", 1) for i in range(n)]
    assert got(M.manifest(spark.createDataFrame(rows, DOC))) == brute(rows)


def test_many_languages(spark, small_blocks):
    rows = [(i, "T", f"l{i % 30}", "s", 1) for i in range(90)]
    assert got(M.manifest(spark.createDataFrame(rows, DOC))) == brute(rows)


def test_whole_table_and_no_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    want = brute(rows)
    assert got(M.manifest(docs)) == want
    assert 0 < sum(not r[-1] for r in want) < len(rows)
    assert M.manifest(docs.limit(0)).collect() == []


def test_places_do_not_put_a_key_into_one_task(spark):
    tables = M.S.Scratch(spark)
    rows = spark.range(20_000).selectExpr("if(id < 15000, 'a', 'b') as key", "cast(null as long) as doc_id", "cast('x' as binary) as leaf")
    placed = M.placed(rows, ["doc_id", "leaf"], 20_000, tables, "t")
    seen = placed.groupBy("key").agg(F.min("pos"), F.max("pos"), F.min("total"), F.max("total")).collect()
    assert {tuple(r) for r in seen} == {("a", 0, 14_999, 15_000, 15_000), ("b", 0, 4_999, 5_000, 5_000)}
    assert placed.select("key", "pos").distinct().count() == 20_000
    parts = spark.read.parquet(tables.paths["t"]).groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 8_000
