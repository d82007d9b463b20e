import random

import numpy as np

from lumenfold.llm import decontaminate as D


def distance_within(item, text):
    """Least edit distance of item to a substring of text, by rows of the whole matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def norm(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    return D.normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def edited(rng, t, rate):
    out = []
    for c in t:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice("abcdef") if x < 2 * rate / 3 else c)
        if 2 * rate / 3 <= x < rate:
            out.append(rng.choice("abcdef"))
    return "".join(out)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 20))).encode()
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))).encode()
        assert D.edits_within(a, b) == distance_within(a, b)


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    docs = [(i, t[:700]) for i, t in enumerate(texts)]
    for k in range(120):
        item = rng.choice(items)[1]
        docs.append((1000 + k, texts[k % 60][:300] + " " + edited(rng, item, [0, 0.02, 0.05, 0.08][k % 4]).upper() + "; " + texts[k % 50][:200]))
    got = {(r.doc_id, r.item_id): r.edits for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        body = norm(t)
        for j, b in items:
            b = norm(b)
            share = {tuple(b.split()[k : k + 2]) for k in range(len(b.split()) - 1)} & {tuple(body.split()[k : k + 2]) for k in range(len(body.split()) - 1)}
            if len(share) < 2:
                continue  # without two pairs of words in common ten per cent of edits can't be met here
            e = D.edits_within(b, body)
            if e <= int(D.MAX_EDIT * len(b)):
                want[i, j] = e
    assert got.items() <= want.items() or all(want.get(k, 99) <= v for k, v in got.items())
    assert got.keys() <= want.keys() and len(want) > 100
    assert len(got) >= 0.97 * len(want)


def test_odd_rows(spark):
    item = "What is the airspeed velocity of an unladen swallow that carries a coconut?"
    docs = spark.createDataFrame([(1, "So: " + item, 1), (2, None, 1), (3, "", 1), (None, item.upper() + " x", 1), (4, "word " * 200_000 + item, 1), (4, "nothing", 1), (5, "an unladen swallow that", 1), (6, item.replace(" ", " | "), 1)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, None, "x"), (None, "a b c d e", "x"), (9, "", "x"), (10, "two words", "x")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in D.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, 7, 0), (None, 7, 0), (4, 7, 0), (6, 7, 0)], key=str)
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert D.leaks(docs, bench.limit(0)).collect() == [] and D.leaks(docs.limit(0), bench).collect() == []


def test_recall_without_unchanged_words():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    bodies = [" ".join(rng.choices(words, k=n)).encode() for n in (1, 2, 5, 8, 8, 12, 12, 16, 16, 20, 20, 40)]
    bodies += ["\u4e2d\u6587\u6ca1\u6709\u8bcd\u7684\u53e5\u5b50\u4e5f\u8981\u627e\u5230".encode()]
    items = D.Items(np.arange(len(bodies)), bodies).prepared()
    for rate in (0.0, 0.05, 0.08, 0.10):
        texts = []
        for k in range(260):
            body = bytearray(bodies[k % len(bodies)])
            for _ in range(int(rate * len(body))):
                at, kind = rng.randrange(len(body)), rng.randrange(3)
                body[at : at + (kind != 0)] = b"" if kind == 2 else rng.choice("xyz0123").encode()
            texts.append(" ".join(rng.choices(words, k=6)).encode() + bytes(body) + " ".join(rng.choices(words, k=6)).encode())
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = {(t, j): e for t, j, e in D.leaks_of(buf, off, items)}
        low, at = D.normalised(buf, off)
        least = {(t, j): D.edits_within(b, low[at[t] : at[t + 1]].tobytes()) for t in range(len(texts)) for j, b in enumerate(bodies)}
        want = {k for k, e in least.items() if e <= int(D.MAX_EDIT * len(bodies[k[1]]))}
        assert got.keys() <= want and len(want) >= 250
        assert len(got) >= (0.97 if rate else 1) * len(want)


def test_recall_of_short_items_and_of_the_target():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    bodies = [" ".join(rng.choices(words, k=n)).encode() for n in range(1, 61)]
    assert D.repetitions(0.999) > D.repetitions(0.99) > D.repetitions(0.5) >= 1
    items = D.Items(np.arange(len(bodies)), bodies).prepared()
    for rate in (0.02, 0.05, 0.08, 0.10):
        texts = []
        for k in range(180):
            body = bytearray(bodies[k % 6 if k < 60 else k % len(bodies)])
            for _ in range(int(rate * len(body))):
                at, kind = rng.randrange(len(body)), rng.randrange(3)
                body[at : at + (kind != 0)] = b"" if kind == 2 else rng.choice("xyz0123").encode()
            texts.append(" ".join(rng.choices(words, k=4)).encode() + b" " + bytes(body) + b" " + " ".join(rng.choices(words, k=4)).encode())
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = {(t, j) for t, j, _ in D.leaks_of(buf, off, items)}
        low, at = D.normalised(buf, off)
        want = {(t, j) for t in range(len(texts)) for j, b in enumerate(bodies) if D.edits_within(b, low[at[t] : at[t + 1]].tobytes()) <= int(D.MAX_EDIT * len(b))}
        short = {(t, j) for t, j in want if j < 6}
        assert got <= want and len(got) >= 0.9 * len(want) and len(got & short) >= 0.9 * len(short) > 20


def test_very_long_item_beside_short_ones():
    rng = random.Random(3)
    long = bytes(rng.choice(b"abcdefgh ") for _ in range(100_000)).replace(b"  ", b" a").strip()
    items = D.Items(np.array([1, 2]), [long, b"a short item of some words"]).prepared()
    changed = bytearray(long)
    for at in range(500, len(changed), 4000):
        changed[at] = ord("z")
    text = b"before " + bytes(changed) + b" a short item of some words after"
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    got = {(t, j): e for t, j, e in D.leaks_of(buf, off, items)}
    assert got.keys() == {(0, 0), (0, 1)} and got[0, 1] == 0 and 0 < got[0, 0] <= 25
    assert all(len(x) * 2 * 100_000 <= max(D._MOST_HELD, 2 * 100_000) for x in items.by_size(np.zeros(5000, np.int64)))


def test_slices_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 2)
    bench = spark.createDataFrame([(k, f"benchmark item number {k} has these words") for k in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"say: benchmark item number {k} has these words") for k in range(5)] + [(9, "clean")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).where("edits = 0").collect()} == {(k, k) for k in range(5)}
    assert [r.doc_id for r in D.decontaminated(docs, bench).collect()] == [9]
