"""Snapshots and hash trees against the whole."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import hash_tree, ledger, snapshots
from lumenfold.sources import versioned

EVENT = "stream string, seq long, event_id long, ts timestamp_ntz, kind string, writer string, path string"


def events(spark, n=400, seed=3):
    pick = random.Random(seed)
    seq = {}
    out = []
    for i in range(n):
        s = pick.choice("abc")
        seq[s] = seq.get(s, 0) + 1
        out.append((s, seq[s], i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), pick.choice(["claim", "claim", "release", "resolve", "note", None]), pick.choice("xyz"), f"p{pick.randint(0, 9)}"))
    return spark.createDataFrame(out, EVENT)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_a_snapshot_and_later_events_fold_to_the_whole(spark, tmp_path):
    every, path = events(spark), f"{tmp_path}/s"
    want = rows(ledger.owned(every, ["ts", "event_id"]))
    none = spark.createDataFrame([], snapshots.SNAPSHOT)
    assert rows(snapshots.held(snapshots.advanced(none, every))) == want
    versioned.publish(snapshots.advanced(none, every.where("event_id < 150")), path)
    half = versioned.read(spark, path)
    assert snapshots.later(every, half).count() == 250
    versioned.publish(snapshots.advanced(half, every.where("event_id < 300")), path)
    whole = snapshots.advanced(versioned.read(spark, path), every)
    assert rows(snapshots.held(whole)) == want
    assert rows(snapshots.advanced(whole, every)) == rows(whole)
    assert rows(snapshots.held(versioned.read(spark, path, 1))) == rows(ledger.owned(every.where("event_id < 150"), ["ts", "event_id"]))


def test_compaction_keeps_the_fold(spark):
    every = events(spark)
    snapshot = snapshots.advanced(spark.createDataFrame([], snapshots.SNAPSHOT), every.where("event_id < 300"))
    left = snapshots.compacted(every, snapshot, keep=10)
    assert left.count() == every.where("event_id >= 300").count()
    assert rows(snapshots.held(snapshots.advanced(snapshot, left))) == rows(ledger.owned(every, ["ts", "event_id"]))
    assert snapshots.compacted(every, snapshots.advanced(snapshot, every), keep=10).count() == 30


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sync_by_trees_equals_the_join_of_all(spark, seed, monkeypatch):
    pick = random.Random(seed)
    local, remote = [], []
    for s in range(12):
        n, m, cut = pick.randint(0, 90), pick.randint(0, 90), pick.randint(1, 120)
        local += [(f"s{s}", k, f"h{k}") for k in range(1, n + 1)]
        remote += [(f"s{s}", k, f"h{k}" if k < cut else f"x{k}") for k in range(1, m + 1) if pick.random() > 0.01]
    a, b = (spark.createDataFrame(x, "stream string, seq long, hash string") for x in (local, remote))
    monkeypatch.setattr(hash_tree.levels, "__defaults__", (4,))
    monkeypatch.setattr(hash_tree.first_differences, "__defaults__", (4,))
    assert rows(hash_tree.suffix_sync(a, b)) == rows(ledger.suffix_sync(a, b))
    trees = [hash_tree.levels(x.select("stream", (F.col("seq") - 1).alias("pos"), "hash"), ["stream"]) for x in (a, a)]
    assert hash_tree.first_differences(*trees, ["stream"]).collect() == []
    assert rows(hash_tree.suffix_sync(a, a.limit(0))) == [] and rows(hash_tree.suffix_sync(a.limit(0), b)) == rows(ledger.suffix_sync(a.limit(0), b))


def plain_root(files, fanout):
    H = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nodes = [h for _, h in sorted((rel, H(rel + "\n" + ("-" if t is None else H(t)))) for rel, t in files)]
    size = len(nodes) - 1
    while True:
        nodes = [H("\n".join(f"{i}={h}" for i, h in enumerate(nodes[k : k + fanout]))) for k in range(0, len(nodes), fanout)]
        size //= fanout
        if size <= 0:
            return nodes[0]


def test_folder_digests(spark):
    files = [("a", f"f{i:03}", f"text {i}") for i in range(100)] + [("b", "x", None), ("b", "x", "y"), (None, "n", "t")]
    got = {r.folder: (r.files, r.digest) for r in hash_tree.folder_digests(spark.createDataFrame(files, "folder string, rel string, text string").repartition(4), ["folder"], 4).collect()}
    one = lambda f: [(rel, t) for x, rel, t in files if x == f]
    deep = {f: plain_root(one(f), 4) for f in ("a",)}
    assert got["a"] == (100, deep["a"]) and got["b"][0] == 2 and got[None][0] == 1
    assert hash_tree.folder_digests(spark.createDataFrame([], "folder string, rel string, text string"), ["folder"]).collect() == []
