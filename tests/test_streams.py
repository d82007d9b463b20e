"""Streams against their batch twins, with late rows, restarts and ends of time."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import chain
from lumenfold.streaming import available, chains, inbox, leases

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def put(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


MESSAGE, ACK, BEAT = "message_id string, at timestamp, lane string", "message_id string, acked_at timestamp", "session string, at timestamp"


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))


def test_streamed_inbox_equals_the_batch_at_the_end_and_drops_late_rows(spark, tmp_path):
    m, a, out = tmp_path / "m", tmp_path / "a", f"file://{tmp_path}/out"

    def run():
        stream = inbox.unread(read(spark, m, MESSAGE), read(spark, a, ACK), "5 HOURS")
        return sorted((r.message_id, r.batch) for r in available.run_available(stream, out).collect())

    put(spark, m, 1, [("read", at(0), "x"), ("unread", at(0), "x"), ("acked late", at(1), "y"), ("waits", at(9), "y")], MESSAGE)
    put(spark, a, 1, [("read", at(2)), ("nothing", at(3)), ("acked late", at(7))], ACK)
    assert [x[0] for x in run()] == ["unread"]  # watermarks are 8 and 6 hours, and the least counts: past 0 + 5 hours, not past 1 + 5
    put(spark, m, 2, [("tick", at(20), "x")], MESSAGE)
    put(spark, a, 2, [("tick", at(20))], ACK)
    first = run()
    assert [x[0] for x in first] == ["acked late", "unread", "waits"]
    put(spark, m, 3, [("too late", at(2), "x"), ("end", at(1000), "x")], MESSAGE)
    put(spark, a, 3, [("unread", at(3)), ("end", at(1000))], ACK)
    assert run() == first  # the late message is dropped, the late ack changes nothing
    batch = inbox.unread(spark.read.option("recursiveFileLookup", True).schema(MESSAGE).parquet(str(m)), spark.read.option("recursiveFileLookup", True).schema(ACK).parquet(str(a)), "5 HOURS")
    assert sorted(r.message_id for r in batch.collect() if r.message_id not in ("too late",)) == ["acked late", "waits"]


def test_leases(spark, tmp_path):
    beats, out = tmp_path / "b", f"file://{tmp_path}/out"

    def run():
        changes = leases.lease_changes(read(spark, beats, BEAT), 7200)
        return sorted((r.session, r.at, r.state) for r in available.run_available(changes, out, "update").collect())

    put(spark, beats, 1, [("a", at(0)), ("a", at(1)), ("b", at(0)), ("c", at(0)), ("c", at(2)), ("c", at(2)), (None, at(1)), ("d", None)], BEAT)
    put(spark, beats, 1, [("e", at(0)), ("e", at(2.5))], BEAT)
    assert run() == [("a", at(0), "active"), ("b", at(0), "active"), ("c", at(0), "active"), ("e", at(0), "active"), ("e", at(2), "expired"), ("e", at(2.5), "active")]
    put(spark, beats, 2, [("a", at(2.9)), ("x", at(3.6))], BEAT)  # a heartbeat extends a's lease; the watermark passes b's end
    second = run()
    assert ("b", at(2), "expired") in second and not [r for r in second if r[0] in "ac" and r[2] == "expired"]
    put(spark, beats, 3, [("b", at(4)), ("x", at(5.5))], BEAT)  # after a restart from the checkpoint c's timer is still there
    third = run()
    assert ("c", at(4), "expired") in third and ("b", at(4), "active") in third and ("a", at(4.9), "expired") not in third
    put(spark, beats, 4, [("end", dt.datetime(2200, 1, 1))], BEAT)
    final = run()
    batch = leases.lease_changes(spark.read.option("recursiveFileLookup", True).schema(BEAT).parquet(str(beats)), 7200)
    assert [r for r in final if r[0] != "end"] == sorted((r.session, r.at, r.state) for r in batch.collect() if r.session != "end")


def sealed(spark, streams, n):
    drafts = [(s, k, f"{s}{k}", "t", str(at(k)), f"p{k}") for s in streams for k in range(1, n + 1)]
    none = spark.createDataFrame([], "stream string, seq long, id string, hash string")
    events = chain.append(none, spark.createDataFrame(drafts, "stream string, ordinal long, id string, type string, ts string, payload string")).drop("ordinal")
    return {(r.stream, r.seq): r.asDict() for r in events.collect()}


def test_chains_out_of_order(spark, tmp_path):
    events, folder, out = sealed(spark, "abc", 9), tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()

    def run(n, rows):
        (folder / f"{n}.json").write_text("".join(json.dumps(r) + "\n" if isinstance(r, dict) else r + "\n" for r in rows))
        found = available.run_available(chains.chain_report(chains.event_lines(spark, str(folder)), "3 hours"), out, "update")
        return sorted((r.stream, r.seq, r.code) for r in found.collect())

    e = lambda s, *ks: [events[s, k] for k in ks]
    assert run(1, [*e("a", 3, 1), *e("b", 2), "no json", {"stream": "a"}]) == [("a", 1, "ok")]
    assert run(2, [*e("a", 2), *e("b", 1, 1)]) == [("a", 1, "ok"), ("a", 2, "ok"), ("a", 3, "ok"), ("b", 1, "ok"), ("b", 1, "repeated"), ("b", 2, "ok")]
    forged = {**events["b", 3], "payload": "forged"}
    unlinked = {**events["b", 4], "prev_hash": "x"}
    third = run(3, [forged, unlinked, *e("c", 1, 3, 4)])  # c lacks 2; the watermark isn't past 3 yet
    assert {r for r in third if r[0] == "b"} >= {("b", 3, "hash"), ("b", 4, "hash"), ("b", 4, "previous-hash")} and ("c", 2, "gap") not in third
    fourth = run(4, e("a", 4, 5, 6, 7, 8, 9))
    assert {r for r in fourth if r[0] == "c"} == {("c", 1, "ok"), ("c", 2, "gap"), ("c", 3, "ok"), ("c", 4, "ok")}
    assert [r for r in fourth if r[0] == "a"] == [("a", k, "ok") for k in range(1, 10)]
    assert ("c", 2, "repeated") in run(5, [{**events["c", 2], "ts": str(at(9))}])


@pytest.mark.parametrize("seed", [1, 2])
def test_a_shuffled_chain_is_sound(spark, tmp_path, seed):
    import random

    rows = list(sealed(spark, "xy", 40).values())
    random.Random(seed).shuffle(rows)
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[k::4]))
    report = chains.chain_report(chains.event_lines(spark, str(tmp_path), 1), "1000 hours")
    found = available.run_available(report, f"file://{tmp_path}/out", "update")
    assert sorted((r.stream, r.seq, r.code) for r in found.collect()) == sorted((s, k, "ok") for s in "xy" for k in range(1, 41))


def test_closing_row(spark, tmp_path):
    put(spark, tmp_path / "m", 1, [("u", at(0), "x")], MESSAGE)
    put(spark, tmp_path / "a", 1, [("v", at(0))], ACK)
    spark.range(1).write.parquet(f"{tmp_path}/end")
    end = spark.readStream.schema("id long").parquet(f"{tmp_path}/end")
    stream = inbox.unread(available.closed(read(spark, tmp_path / "m", MESSAGE), "at", end, message_id="end"), available.closed(read(spark, tmp_path / "a", ACK), "acked_at", end, message_id="end"), "5 HOURS")
    assert [r.message_id for r in available.run_available(stream, f"file://{tmp_path}/out").collect()] == ["u"]
    assert available.closed(spark.createDataFrame([("m", at(0), "x")], MESSAGE), "at", spark.range(1)).where(F.col("message_id").isNull()).count() == 1


def test_ownership_is_folded_without_rows_in_python(spark, tmp_path, monkeypatch):
    from lumenfold.streaming import ownership

    monkeypatch.setattr(ownership, "_Holders", None)  # no state by row
    rows = [(1, at(0), "claim", "a", "p"), (2, at(1), "claim", "b", "p"), (3, at(0.5), "resolve", "z", "p"), (4, at(1), "claim", "a", None), (5, at(2), "resolve", "z", None), (6, at(3), "claim", "c", "q"), (7, at(4), "release", "c", "q")]
    schema = "event_id long, ts timestamp, kind string, writer string, path string"
    put(spark, tmp_path / "e", 1, rows, schema)
    assert [tuple(r) for r in ownership.fold_available(read(spark, tmp_path / "e", schema)).collect()] == [("b", "p", at(1))]


class Store:
    """A handle of one stream's state in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.value, self.map = 0, set(), None, {}

    def getValueState(self, name, schema):
        store = self
        return type("V", (), {"exists": lambda _: store.value is not None, "get": lambda _: store.value, "update": lambda _, v: setattr(store, "value", v)})()

    def getMapState(self, name, keys, values):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"getValue": self.map.get, "containsKey": self.map.__contains__, "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "iterator": lambda: iter(list(self.map.items())), "keys": lambda: iter(list(self.map)), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name](*args)

        return call


def test_a_long_run_of_early_events_takes_few_calls_to_the_state():
    import random

    import pandas as pd

    n, store = 3000, Store()
    rows = [(k, f"e{k}", f"e{k - 1}" if k > 1 else None, f"h{k - 1}" if k > 1 else None, f"h{k}", True, 1000 + k) for k in range(1, n + 1) if k not in (2, 700, 2500)]
    random.Random(1).shuffle(rows)
    one = chains._Chain()
    one.init(store)
    frame = pd.DataFrame(rows, columns=["seq", "id", "prev_id", "prev_hash", "hash", "sound", "at_ms"])
    told = [r for part in (frame[:1000], frame[1000:]) for f in one.handleInputRows(("s",), iter([part]), None) for r in f.itertuples(index=False, name=None)]
    assert told == [("s", 1, "ok")] and len(store.timers) == 1
    for watermark in (3000, 1 << 40):  # it first passes number 2,000, then all
        due = store.timers.pop()
        assert not store.timers
        told += [r for f in one.handleExpiredTimer(("s",), type("T", (), {"getCurrentWatermarkInMs": lambda s: watermark})(), type("E", (), {"getExpiryTimeInMs": lambda s: due})()) for r in f.itertuples(index=False, name=None)]
        assert told[-1] == ("s", 2499 if watermark == 3000 else n, "ok")
    assert sorted(told) == sorted([("s", k, "gap" if k in (2, 700, 2500) else "ok") for k in range(1, n + 1)]) and not store.map
    assert store.calls < 200
