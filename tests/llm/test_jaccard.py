import random
import re

import duckdb
import numpy as np
import pytest

from lumenfold.llm import graph
from lumenfold.llm import jaccard as J
from lumenfold.llm import queries as Q


def brute(rows):
    """(doc_id -> (n, component)) by all pairs."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in sets}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{d}/documents.parquet'")
        want = sorted(c.sql(J.ORACLE).fetchall())
    assert sorted(map(tuple, Q.op2_jaccard_join(spark, d).collect())) == want


@pytest.mark.parametrize("block", [4, 128])
def test_chains_passages_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "COUNTED", 1)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    base = [word() for _ in range(60)]
    for k in range(40):  # a chain: neighbours are near, the ends are not
        at = rng.randrange(60)
        base = [*base]
        base[at] = word()
        rows.append((" ".join(base)))
    for k in range(40):  # a passage that unlike texts share, at shares around the threshold
        rows.append(" ".join(passage + [word() for _ in range(rng.choice([1, 2, 3, 5, 9, 40]))]))
    rows += [rows[3].upper(), rows[3], "  " + rows[50] + "\n", "a b", "A  b", "a b c", "", " \n", "x", None]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) > 10


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (2, "a b c d e f", "x"), (3, "g h i j k l", "x"), (None, "a b c d e f", "x"), (None, None, "x"), (9, "w " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (9, 1, 9), (None, 0, None), (None, 2, 1)], key=str)
    assert J.one_of_each(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in J.one_of_each(docs).collect()) == ["1", "9", "None"]
    assert J.near_duplicates(docs.limit(0)).collect() == []


def test_tree_join_leaves_out_no_pair():
    rng = np.random.default_rng(1)
    sets = [set(rng.choice(400, rng.integers(10, 60), False).tolist()) for _ in range(30)]
    for k in range(40):
        s = set(sets[rng.integers(len(sets))])
        for _ in range(rng.integers(1, 6)):
            s.discard(next(iter(s)))
            s.add(int(rng.integers(400)))
        sets.append(s)
    sig = np.zeros((len(sets), 512), bool)
    for i, s in enumerate(sets):
        sig[i, [x % 512 for x in s]] = True
    packed = np.packbits(sig, axis=1).view(np.uint64)
    size, comp = np.array([len(s) for s in sets]), rng.integers(0, 40, len(sets))
    a, b, _ = J.SignatureTree(size, packed, comp).self_join()
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want <= got and len(got) == len(a) and len(got) < 0.2 * len(sets) ** 2 / 2


def test_sketches_never_allow_too_little():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(5, 4000))
        words = rng.integers(0, 1 << 62, 2 * n)
        texts = [" ".join(f"w{k}" for k in words[i : i + n]) for i in (0, int(rng.integers(0, n)))]
        raw = [t.encode() for t in texts]
        sets = [set(J.shingles(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0].tolist()) for r in raw]
        rows = J.pa.RecordBatch.from_arrays([J.pa.array([1, 2]), J.pa.array(texts)], names=["doc_id", "text"])
        (x, nx), (y, ny) = [(s, k) for b in J._sketched([rows]) for s, k in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
        both = len(sets[0] & sets[1])
        bound = J.sketch_overlap(x, nx, y, ny)
        assert (nx, ny) == (len(sets[0]), len(sets[1])) and both <= bound <= both + 0.35 * (nx - both) + 5


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(160, 159), (7, 7), (1, 0)] + [(200, 201)] * 3
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 161)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("main", [1, 90])
def test_large_blocks_have_bounded_parts_and_every_pair(spark, monkeypatch, main):
    monkeypatch.setattr(J, "BLOCK", 16)
    comp = {i: min(i, 0) if i < main else i for i in range(300)}
    postings = spark.createDataFrame([(7, i) for i in comp], "shingle long, doc_id long")
    described = spark.createDataFrame([(i, 50, b"") for i in comp], "doc_id long, n_shingles long, sig binary")
    members = {}
    for r in J._blocks(postings, described, spark.createDataFrame(list(comp.items()), "doc_id long, comp long"), J.S.Scratch(spark)).collect():
        members.setdefault(r.block, []).append(r.doc_id)
    assert max(map(len, members.values())) <= 5 * J.BLOCK
    met = {(a, b) for docs in members.values() for a in docs for b in docs if comp[a] != comp[b]}
    assert met == {(a, b) for a in comp for b in comp if comp[a] != comp[b]}


def test_leaf_pairs_in_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 63, (90, J.SIGNATURE_WORDS)).astype(np.uint64)
    tree = J.SignatureTree(np.full(90, 10_000), sig, np.arange(90))
    want = [x.tolist() for x in tree.self_join()]
    monkeypatch.setattr(J, "LEAF_PAIRS", 3)
    assert [x.tolist() for x in tree.self_join()] == want and want[0]


def test_a_hot_node_and_a_hot_payload_are_split(spark):
    """Most rows on one key: the joins of a component's step and of equal payloads may be dealt out to several tasks."""
    from pyspark.sql import functions as F

    from lumenfold.llm import shared as S
    from lumenfold.llm import warc

    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        both = S.settle(spark.range(1, 60_000, numPartitions=8).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") - 1).alias("u"), F.col("id").alias("v")), "edges")
        step = graph.star(both, S.settle(graph.large_least(both), "least"))
        pages = spark.range(8_000, numPartitions=8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 10 < 7, F.repeat(F.lit("same"), 300)).otherwise(F.concat(F.repeat(F.lit("x"), 1000), F.col("id").cast("string"))).alias("html"))
        for rows in (step, warc.decide(pages)):
            frame = rows.groupBy().agg(*[F.max(c) for c in rows.columns])
            frame.collect()
            assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
