import hashlib
import random

import numpy as np
import pytest

from lumenfold.llm import suffix_dedup as D


def brute(rows, length=100):
    """{doc_id: (bytes, removed, spans, sha256)} with a dictionary of all windows; rows in order of doc_id."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(D.suffix_dedup(docs)) == want
    assert sum(x[1] for x in want.values()) > 1000


@pytest.mark.parametrize("bucket,most", [(400_000, 2000), (500, 2000), (20_000, 5), (1, 3), (3_000, 1)])
def test_planted_repeats(spark, bucket, most):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdeé fgh") for _ in range(n))
    passage, rows = noise(260), []
    for k in range(12):
        at = rng.randrange(160)
        rows.append(noise(rng.randrange(200)) + passage[at : at + rng.choice([60, 99, 100, 101, 140])] + noise(rng.randrange(90)) + passage)
    rows += [rows[2], rows[3][:150], rows[4] + "x", "ab" * 200, "ab" * 90, "z" * 99, "z" * 100, "z" * 101, "y" * 150, None, "", noise(40) + passage[:100].upper() + passage[1:140]]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(D.suffix_dedup(docs, bucket, most)) == want
    if bucket == 500:
        kept = {r.doc_id: r for r in D.without_repeats(docs.selectExpr("doc_id", "text", "'x' AS places", "1 AS _doc", "2 AS h", "3 AS row", "99L AS n_chars"), bucket, most).collect()}
        assert all((r.places, r._doc, r.h, r.row) == ("x", 1, 2, 3) for r in kept.values())
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.values())
        assert all(len((r.text or "").encode()) <= want[i][0] - want[i][1] for i, r in kept.items())


def test_hot_passage_in_every_text_and_hot_gram_with_unlike_surroundings(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, gram = noise(150), noise(25)
    rows = [(i, noise(70) + (passage if i % 3 else gram * (1 + i % 2)) + noise(120)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(D.suffix_dedup(docs, 2000, 7)) == brute(rows)


def test_every_removal_comes_out_of_a_sorted_bucket(spark, monkeypatch):
    real, found = D._sorted, []

    def counted(*args):
        out = real(*args)
        found.append(out)
        return out

    monkeypatch.setattr(D, "_sorted", counted)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = D.removals(docs).selectExpr("explode(places) AS p").selectExpr("sum(p & 127)").first()[0]
    assert len(found) == 1 and n > 1000


def test_text_longer_than_a_block(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    buf = np.frombuffer(long.encode(), np.uint8)
    whole = D.runs(buf, np.array([0, len(buf)]))[2]
    monkeypatch.setattr(D.S, "BLOCK_BYTES", 1000)
    parts = [D.runs(b, off)[2] + (at << 14) for at, b, off in D._slabs(D.S.Block(None, buf, np.array([0, len(buf)])))]
    windows = lambda places: {(p >> 14) + k for p in places.tolist() for k in range(p & 127)}
    assert windows(np.concatenate(parts)) == windows(whole) == set(range(9000 - 99))


def test_odd_rows(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away from it all, never to be seen again by anybody, ever"
    rows = [(1, t, "x"), (1, t, "x"), (2, t, "x"), (None, t, "x"), (None, None, "x"), (3, "q" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    for limits in ((400_000, 2000), (400_000, 2)):
        out = sorted(((r.doc_id, r.n_removed, r.n_spans) for r in D.suffix_dedup(docs, *limits).collect()), key=str)
        assert out == sorted([(1, 0, 0), (1, 0, 0), (2, len(t), 1), (None, 0, 0), (None, 0, 0), (3, 300_000 - 1, 1)], key=str)
    assert D.suffix_dedup(docs.limit(0)).collect() == []
    kept = D.without_repeats(docs)
    assert sorted((str(r.doc_id), len(r.text or ""), r.places) for r in kept.collect()) == sorted([("1", len(t), "x"), ("1", len(t), "x"), ("2", 0, "x"), ("None", len(t), "x"), ("None", 0, "x"), ("3", 1, "x")])
    assert D.without_repeats(docs.limit(0)).collect() == []


def test_sorted_suffixes():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(97, 99, 300), np.full(150, 97), np.tile([97, 98, 99], 80), rng.integers(97, 100, 200)]).astype(np.uint8)
    at = rng.permutation(len(text) - 100)
    order = D.sort_suffixes(text, at)
    keys = [text[i : i + 100].tobytes() for i in at[order]]
    assert keys == sorted(keys)


def contexts(rows):
    """A bucket of whole texts as contexts, an anchor at their 60th byte."""
    import pyarrow as pa

    n = [len(b) - D.LENGTH + 1 for _, b in rows]
    place = D._place(np.zeros(len(rows), np.int64), np.full(len(rows), 60), np.array(n))
    return pa.table({"doc_id": pa.array([i for i, _ in rows]), "h": pa.array([0] * len(rows)), "place": pa.array(place), "body": pa.array([b for _, b in rows], pa.binary())})


def windows_gone(batch):
    return {(d, (p >> 14) + k) for g, d, p in zip(*(batch.column(c).to_pylist() for c in ("gone", "doc_id", "place"))) if g for k in range(p & 127)}


def test_every_removed_window_is_decided_by_a_run_of_the_suffix_sort(monkeypatch):
    """Copies, and contexts that share a part. Each distinct context is sorted once; where the sort found no equal windows, only a window's later holders would go."""
    rng = random.Random(8)
    noise = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    one, part = noise(180), noise(130)
    rows = [(5, one), (2, one), (9, one), (3, part + noise(30)), (4, part + noise(30)), (1, b"x" * 170), (7, b"x" * 170), (8, b"x" * 140)]
    seen, want = set(), set()
    for doc, body in sorted(rows):
        for k in range(len(body) - 99):
            (want.add if body[k : k + 100] in seen else lambda _: None)((doc, k))
            seen.add(body[k : k + 100])
    real, asked = D.window_runs, []

    def counted(text, at, order_of):
        asked.append(len(at))
        return real(text, at, order_of)

    monkeypatch.setattr(D, "window_runs", counted)
    for firsts in (False, True):
        assert windows_gone(D._resolve(contexts(rows), firsts)) == want
    assert asked == [sum(len(b) - 99 for b in {b for _, b in rows})] * 2  # each distinct context once
    monkeypatch.setattr(D, "window_runs", lambda text, at, order_of: (np.arange(len(at)), np.arange(len(at))))
    only_copies = windows_gone(D._resolve(contexts(rows), False))
    assert only_copies == {(d, k) for d, b in ((5, one), (9, one), (7, b"x" * 170)) for k in range(len(b) - 99)}
