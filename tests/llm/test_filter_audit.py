import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import filter_audit as A
from lumenfold.llm import shared as S

DOC = "doc_id long, text string, lang string"


def failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield i, lang or "", {
            c
            for c, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]))
            if bad
        }


def brute(rows, labels):
    """The figures by walking every order over every row."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = list(failures(rows))
    out, share = {}, Counter()
    for part in {p for _, p, _ in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in rows if p == part]
            every = list(left)
            for step, c in enumerate(order, 1):
                gone = [i for i, f in left if c in f]
                earlier = sum(c in f for _, f in every) - len(gone)
                left = [(i, f) for i, f in left if c not in f]
                share[part, c] += len(gone)
                out[part, order, step] = [len(left), len(gone), earlier, sum(f == {c} for _, f in every), sum(i in good for i in gone), sum(i in toxic for i in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, LONG, "en"),
    (2, LONG, "en"),
    (2, LONG, "de"),
    (None, LONG, "en"),
    (3, None, None),
    (4, "", ""),
    (5, " \t\n ", "fr"),
    (6, "AB CD", "fr"),
    (7, "x # y " * 60, "fr"),
    (8, "é日\x0bA b " * 40, None),
    (9, "word " * 30_000, "en"),
    (9, "word " * 30_000, "en"),
    (None, None, None),
    (10, LONG.upper(), "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, 1), (7, 1, None), (99, 1, 1), (9, 0, 1)]


def test_odd_rows_against_every_order(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], DOC + ", mask string, hash int")
    labels = spark.createDataFrame([(*r, 7) for r in LABELS], "doc_id long, quality int, toxic int, n int")
    assert got(A.filter_audit(docs, labels)) == brute(ROWS, LABELS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOC), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs, labels).collect() == []
    assert got(A.filter_audit(spark.createDataFrame(ROWS[:3], DOC), labels.limit(0))) == brute(ROWS[:3], [])


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert got(A.filter_audit(docs, labels)) == brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


@pytest.mark.parametrize("segments", [1, 7])
def test_the_sketch_clears_unique_texts_only(spark, segments):
    texts = [f"text {i}" for i in range(3000)] + [f"twice {i % 500}" for i in range(1000)] + ["hot"] * 2000
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5).select("text", F.xxhash64("text").alias("hash"))
    seen = A.with_repeatable(rows, A.repeat_sketch(rows, segments), segments).collect()
    assert len(seen) == len(texts)
    assert all(r.repeatable for r in seen if not r.text.startswith("text"))
    assert sum(r.repeatable for r in seen if r.text.startswith("text")) < 0.05 * 3000


def test_a_full_sketch_costs_work_but_no_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "with_repeatable", lambda rows, *_: rows.withColumn("repeatable", F.lit(True)))
    docs, labels = spark.createDataFrame(ROWS, DOC), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert got(A.filter_audit(docs, labels)) == brute(ROWS, LABELS)


def test_the_join_with_first_ids_may_split_a_hot_text(spark):
    docs = spark.range(40_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("long").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        tables = S.Scratch(spark)
        rows = tables.settle(A.masks(docs), "m")
        n = A.n_segments(40_000)
        sketch = tables.settle(A.repeat_sketch(rows, n), "s")
        firsts = tables.settle(A.first_ids(docs, sketch, n), "f")
        joined = A.with_repeatable(rows, sketch, n).where("repeatable").join(firsts, "digest", "left")
        assert joined.where("doc_id > first_id").count() == len(range(0, 40_000, 3)) - 1 + _pairs()
        frame = joined.groupBy().agg(F.max("doc_id"), F.count("first_id"))
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _pairs():
    """Later rows of the texts "t<n>" that two ids share."""
    count = Counter(i // 2 for i in range(40_000) if i % 3)
    return sum(n - 1 for n in count.values())
