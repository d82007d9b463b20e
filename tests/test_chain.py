"""Hash chains against a plain second version."""

import hashlib

from pyspark.sql import functions as F

from lumenfold.operators import chain

DRAFT = "stream string, ordinal long, id string, type string, ts string, payload string, context string"
NONE = "stream string, seq long, id string, hash string"


def plain_digest(e):
    names = ("stream", "seq", "id", "type", "ts", "payload", "prev_id", "prev_hash")
    return "sha256:" + hashlib.sha256("".join("-" if e[c] is None else f"{len(str(e[c]).encode())}:{e[c]}" for c in names).encode()).hexdigest()


def plain_chain(events, renumber=True):
    out = {}
    for stream in {e["stream"] for e in events}:
        before = None
        for n, e in enumerate(sorted((e for e in events if e["stream"] == stream), key=lambda e: e["ordinal"]), 1):
            new = {**e, "prev_id": before and before["id"], "prev_hash": before and before["hash"]}
            if renumber:
                new["seq"] = n
            new["hash"] = plain_digest(new)
            new["changed"] = any(new[c] != e.get(c) for c in ("seq", "prev_id", "prev_hash", "hash"))
            out[stream, e["ordinal"]] = before = new
    return out


def rows(df):
    return {(r.stream, r.ordinal): r.asDict() for r in df.collect()}


def sealed(spark, n=12):
    drafts = [(s, k, f"{s}{k}", "claim", f"t{k}", None if k % 4 == 0 else f"ünï {k}", f"c{k}") for s in ("a", "b", "c") for k in range(1, n)]
    return chain.append(spark.createDataFrame([], NONE), spark.createDataFrame(drafts, DRAFT).repartition(3))


def test_append_chains_and_goes_on(spark):
    every = sealed(spark)
    want = plain_chain([e.asDict() for e in every.collect()])
    assert {k: {c: v[c] for c in v if c != "changed"} for k, v in want.items()} == rows(every)
    assert chain.chain_errors(every).collect() == []
    first, rest = every.where("ordinal < 5"), every.where("ordinal >= 5").drop("seq", "prev_id", "prev_hash", "hash")
    more = chain.append(first, rest.unionByName(spark.createDataFrame([("new", 1, "n1", "x", None, None, None), (None, 1, "u1", "x", None, None, None)], DRAFT)))
    got = rows(more)
    assert all(got[k] == v for k, v in rows(every.where("ordinal >= 5")).items())
    for stream in ("new", None):
        assert (got[stream, 1]["seq"], got[stream, 1]["prev_id"], got[stream, 1]["prev_hash"]) == (1, None, None)
    assert chain.append(first, rest.limit(0)).collect() == []


def test_repair_from_the_first_change_on_and_only_there(spark):
    every = sealed(spark)
    bad = every.where("NOT (stream = 'a' AND ordinal IN (5, 6))").withColumn("payload", F.when(F.expr("stream = 'b' AND ordinal = 9"), "forged").otherwise(F.col("payload")))
    errors = {(r.stream, r.ordinal, r.code) for r in chain.chain_errors(bad).collect()}
    assert errors == {("a", 7, "sequence"), ("a", 7, "previous-id"), ("a", 7, "previous-hash"), ("b", 9, "hash")}
    got = rows(chain.rehash(bad))
    assert got == plain_chain([e.asDict() for e in bad.collect()])
    assert {k for k, v in got.items() if v["changed"]} == {("a", k) for k in range(7, 12)} | {("b", k) for k in (9, 10, 11)}
    assert chain.chain_errors(chain.rehash(bad).drop("changed")).collect() == []
    assert not any(r.changed for r in chain.rehash(chain.rehash(bad).drop("changed")).collect())


def test_sequence_numbers_stay_in_a_repair_of_hashes(spark):
    """One break 1 -> 4, and a digest of another age at the second event."""
    every = sealed(spark, 4).where("stream = 'a'").withColumn("seq", F.when(F.col("ordinal") > 1, F.col("seq") + 2).otherwise(F.col("seq")))
    legacy = every.withColumn("hash", F.when(F.col("ordinal") == 2, "sha256:old").otherwise(F.col("hash")))
    got = rows(chain.rehash(legacy, renumber=False))
    assert [got["a", k]["seq"] for k in (1, 2, 3)] == [1, 4, 5]
    assert got == plain_chain([e.asDict() for e in legacy.collect()], renumber=False)
    assert [rows(chain.rehash(legacy))["a", k]["seq"] for k in (1, 2, 3)] == [1, 2, 3]


def test_odd_chains(spark):
    none = sealed(spark).limit(0)
    assert chain.rehash(none).collect() == [] and chain.chain_errors(none).collect() == []
    odd = [(None, 2, 7, None, None, None, None, None, None, None), (None, 1, None, "x", "t", "1", "p", "zz", "h", "h"), ("s", 1, 1, "id", "t", "1", "p", None, None, None)]
    events = spark.createDataFrame(odd, "stream string, ordinal long, seq long, id string, type string, ts string, payload string, prev_id string, prev_hash string, hash string")
    assert rows(chain.rehash(events)) == plain_chain([e.asDict() for e in events.collect()])


def test_context_is_not_covered(spark):
    every = sealed(spark)
    assert chain.chain_errors(every.withColumn("context", F.lit("other"))).collect() == []
